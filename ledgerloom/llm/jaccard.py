"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles. Tokens (hashed shingles) have one global order in
which frequent tokens come last, so a set's prefix, its first n - ceil(t n) + 1 tokens, holds its
rare ones; two sets with similarity t or more share a prefix token. Documents with equal sets
are one class, and classes with identical prefix and size one group. Groups are paired by
shared prefix tokens with size and position filters; pairs are expanded to classes and verified
on whole sets.

What moves between tasks is packed: each task sends a bucket of tokens one binary value, counted
or deduplicated beforehand. A token that many groups hold yields a star at first (each member
with the least of its size band); once components are known, only members of different components
are paired, so that a family of near copies costs its size, not its square, and no link between
components is lost. Any order of tokens gives the same links; only frequent tokens need to be known,
and of those a bounded number (the most frequent) is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import estimated_bytes, forget, free_name, slices, utf8, written
from ledgerloom.llm.words import sets_of_shingles

#: Similarity as a fraction of whole numbers: 4 / 5.
NUM, DEN = 4, 5
#: A token in so many classes (as counted by map tasks) or more is frequent.
FREQUENT = 16
#: At most so many frequent tokens are broadcast (12 bytes each); beyond that, the threshold rises.
MOST_FREQUENT = 2_000_000
#: Runs of up to so many groups of one token are paired in full at once.
SMALL_RUN = 16
#: Bytes of input for each bucket of tokens: a bucket is held by one task, so their number grows with the input.
BUCKET_BYTES = 4 << 20
#: Tokens that a task holds before it sends them on.
HELD_TOKENS = 2_000_000
#: Bits of a set's parity map (folded to a quarter for a first look), and members of a run that are compared in one task.
BITS, BLOCK = 8192, 2048
#: Partners of each member, the closest first, that are verified before all that are left.
CLOSEST = 2
#: Texts to verify are joined by broadcast up to so many bytes of keys, by shuffle beyond.
BROADCAST_BYTES = 64 << 20

_ENTRY = np.dtype([("token", "<u4"), ("group", "<u8"), ("n", "<u4"), ("at", "<u4")])


def prefix_length(n):
    return n - (NUM * n + DEN - 1) // DEN + 1


def _cells(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A token's bucket, and its number of bucket and 32 bits, by which it is counted."""
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return bucket, (bucket.astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def _class_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _counted(sets: list[np.ndarray], buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    _, cells = _cells(np.concatenate(sets), buckets)
    cells, n = np.unique(cells, return_counts=True)
    ends = np.searchsorted(cells >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    low, rows = cells.astype(np.uint32), []
    for b in np.flatnonzero(np.diff(ends)):
        at = slice(ends[b], ends[b + 1])
        one = n[at] == 1
        rows.append((int(b), low[at][one].tobytes(), low[at][~one].tobytes(), n[at][~one].astype(np.uint32).tobytes()))
    return _rows(rows, schema)


def frequent_tokens(docs: DataFrame, text: str, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of frequent tokens, ascending, and their counts over all documents."""
    schema = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        forget()
        sets, seen, held = [], set(), 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                for tokens in sets_of_shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    if len(tokens) and (key := _class_key(tokens)) not in seen:
                        seen.add(key)
                        sets.append(tokens)
                        held += len(tokens)
            if held >= HELD_TOKENS:
                yield _counted(sets, buckets, schema)
                sets, seen, held = [], set(), 0
        if sets:
            yield _counted(sets, buckets, schema)

    out = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        keys, weights = [], []
        for once, more, counts in zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True):
            keys += [np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)]
            weights += [np.ones(len(once) // 4, np.uint32), np.frombuffer(counts, np.uint32)]
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        totals = np.add.reduceat(weights[order].astype(np.int64), first)
        high = totals >= FREQUENT
        cells = (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)) | keys[first[high]].astype(np.uint64)
        return pa.table([cells.view(np.int64), totals[high]], schema=out)

    counted = docs.select(text).mapInArrow(count, "bucket int, once binary, more binary, counts binary")
    found = written(counted.groupBy("bucket").applyInArrow(add, "cell bigint, n bigint"), "frequent")
    least = FREQUENT
    if found.count() > MOST_FREQUENT:
        # The number of frequent tokens for each count is a short table (counts repeat); doubling bounds it.
        by_size = sorted((r.p, r.c) for r in found.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect())
        total = sum(c for _, c in by_size)
        for p, c in by_size:
            if total <= MOST_FREQUENT:
                break
            least, total = 2 ** (p + 1), total - c
    table = found.where(F.col("n") >= least).toArrow()
    cells = table.column("cell").to_numpy().view(np.uint64)
    order = np.argsort(cells)
    return cells[order], np.minimum(table.column("n").to_numpy()[order], 0xFFFFFFFF).astype(np.uint32)


def ordered_sets(raw: np.ndarray, offsets: np.ndarray, k: int, buckets: int, cells: np.ndarray, counts: np.ndarray):
    """For each row, its sorted tokens, and the same tokens in the global order."""
    for tokens in sets_of_shingles(raw, offsets, k):
        if not len(tokens) or not len(cells):
            yield tokens, tokens
            continue
        _, cell = _cells(tokens, buckets)
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        frequent = cells[at] == cell
        if not frequent.any():
            yield tokens, tokens
            continue
        last = tokens[frequent]
        yield tokens, np.concatenate([tokens[~frequent], last[np.lexsort((last, counts[at[frequent]]))]])


def _group_key(prefix: np.ndarray, n: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little"))


def members(docs: DataFrame, id: str, text: str, k: int, buckets: int, shared) -> DataFrame:
    """(id, content, n_shingles, class, group) for each row; class and group are null without shingles."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("group", pa.int64())])

    def run(batches):
        forget()
        cells, counts = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            n, keys, groups = [], [], []
            for i, j in slices(offsets):
                for tokens, ordered in ordered_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, buckets, cells, counts):
                    size = len(tokens)
                    n.append(size)
                    keys.append(_class_key(tokens) if size else None)
                    groups.append(_group_key(ordered[: prefix_length(size)], size).view(np.int64) if size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.int64())], schema=schema)

    rows = docs.select(F.col(id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))), text)
    return rows.mapInArrow(run, "id bigint, content bigint, n_shingles bigint, class binary, group bigint")


def _entries(found: list[tuple], buckets: int, schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(p) for p, _, _ in found]
    tokens = np.concatenate([p for p, _, _ in found])
    rows = np.empty(len(tokens), _ENTRY)
    rows["token"] = tokens.astype(np.uint32)
    rows["group"] = np.repeat(np.array([g for _, g, _ in found], np.uint64), sizes)
    rows["n"] = np.repeat(np.array([n for _, _, n in found], np.uint32), sizes)
    rows["at"] = np.concatenate([np.arange(s, dtype=np.uint32) for s in sizes])
    bucket, _ = _cells(tokens, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = rows[order]
    return _rows([(int(b), rows[ends[b] : ends[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(ends))], schema)


def group_pairs(docs: DataFrame, text: str, k: int, buckets: int, shared) -> DataFrame:
    """Candidates: kind 0, a pair of groups (a, b); kind 1, group a of size n in a long run of a token, with its position."""
    packed = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def entries(batches):
        forget()
        cells, counts = shared.value
        found, seen, held = [], set(), 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                for tokens, ordered in ordered_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, buckets, cells, counts):
                    n = len(tokens)
                    if n < DEN - 1:
                        continue  # only an equal set is similar enough
                    prefix = ordered[: prefix_length(n)].copy()
                    group = _group_key(prefix, n)
                    if group not in seen:
                        seen.add(group)
                        found.append((prefix, group, n))
                        held += len(prefix)
            if held >= HELD_TOKENS // 2:
                yield _entries(found, buckets, packed)
                found, seen, held = [], set(), 0
        if found:
            yield _entries(found, buckets, packed)

    out = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])

    def pair(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
        rows = rows[np.lexsort((rows["group"], rows["token"]))]
        new = np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["group"][1:] != rows["group"][:-1])])
        rows = rows[new]
        starts = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
        sizes = np.diff(np.append(starts, len(rows)))
        firsts, seconds = [], []
        for size in range(2, SMALL_RUN + 1):
            at = starts[sizes == size]
            if len(at):
                x, y = np.triu_indices(size, 1)
                firsts.append((at[:, None] + x).ravel())
                seconds.append((at[:, None] + y).ravel())
        long = []
        for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
            at = start + np.argsort(rows["n"][start : start + size], kind="stable")
            sorted_n = rows["n"][at].astype(np.int64)
            lead = 0
            while lead < size:
                # the band of sizes that can be similar enough to the leader's
                end = int(np.searchsorted(sorted_n * NUM, sorted_n[lead] * DEN, "right"))
                firsts.append(np.full(end - lead - 1, at[lead]))
                seconds.append(at[lead + 1 : end])
                lead = end
            long.append(at)
        pairs = np.zeros((0, 2), np.uint64)
        if firsts:
            f, s = np.concatenate(firsts), np.concatenate(seconds)
            n, m = rows["n"][f].astype(np.int64), rows["n"][s].astype(np.int64)
            most = 1 + np.minimum(n - rows["at"][f] - 1, m - rows["at"][s] - 1)
            fits = (NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)) & ((NUM + DEN) * most >= NUM * (n + m))
            g, h = rows["group"][f[fits]], rows["group"][s[fits]]
            pairs = np.unique(np.stack([np.minimum(g, h), np.maximum(g, h)], 1), axis=0)
        runs = rows[np.concatenate(long)] if long else rows[:0]
        bucket = table.column("bucket")[0].as_py()
        zero, none = np.zeros(len(pairs), np.int64), np.zeros(len(runs), np.int64)
        columns = [
            np.concatenate([zero, none + 1]).astype(np.int32),
            np.concatenate([pairs[:, 0].view(np.int64), runs["group"].view(np.int64)]),
            np.concatenate([pairs[:, 1].view(np.int64), none]),
            np.concatenate([zero, runs["token"].astype(np.int64) | (bucket << 32)]),
            np.concatenate([zero, runs["n"].astype(np.int64)]),
            np.concatenate([zero, runs["at"].astype(np.int64)]),
        ]
        return pa.table([np.ascontiguousarray(c) for c in columns], schema=out)

    blobs = docs.select(text).mapInArrow(entries, "bucket int, entries binary")
    return blobs.groupBy("bucket").applyInArrow(pair, "kind int, a bigint, b bigint, token bigint, n bigint, at bigint")


def sets_of(docs: DataFrame, text: str, k: int, contents: DataFrame) -> DataFrame:
    """(class, tokens) of the texts whose content is listed: broadcast while the list is small, by shuffle beyond."""
    schema = pa.schema([("class", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            seen = {}
            for i, j in slices(offsets):
                for tokens in sets_of_shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
                    seen.setdefault(_class_key(tokens), tokens)
            yield _rows([(c, t.tobytes()) for c, t in seen.items()], schema)

    if contents.count() * 16 <= BROADCAST_BYTES:
        contents = F.broadcast(contents)
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"), text)
    picked = rows.join(contents, "content", "left_semi").select(text)
    return picked.mapInArrow(run, "class binary, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the class pairs (x, y), those whose sets have similarity NUM / DEN or more, with the sizes of intersection and union."""
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("shared", pa.int64()), ("total", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for x, y, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if DEN * shared >= NUM * (len(both) - shared):
                    rows.append((x, y, shared, len(both) - shared))
            yield _rows(rows, schema)

    left = sets.select(F.col("class").alias("x"), F.col("tokens").alias("a"))
    right = sets.select(F.col("class").alias("y"), F.col("tokens").alias("b"))
    joined = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "a", "b")
    return joined.mapInArrow(run, "x binary, y binary, shared bigint, total bigint")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x <> y").distinct()


def jaccard_join(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (id, content, n_shingles, component_id) for each row of ``docs``, and verified
    links (x, y, shared, total) between classes of equal sets.

    With ``all_links``, the links are all pairs of similar classes, and a column ``class`` in the rows tells the
    members; a family of m different near copies then takes the time of m squared comparisons. Else the
    links connect what is similar: a pair of classes may be left out only if both are in one component anyway. ``component_id`` is the smallest id of a component. Null and empty texts
    have no shingles and are linked with nothing, so each row is its own component; texts of
    fewer words than a shingle are one shingle. Repeated rows are members like any other. A null
    id is in its component, whose smallest id is that of the other members (null if there is none).
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(docs.select(text)) // BUCKET_BYTES)
    shared = spark.sparkContext.broadcast(frequent_tokens(docs, text, shingle, buckets))
    rows = written(members(docs, id, text, shingle, buckets, shared), "members")
    classes = written(
        rows.where("class is not null").groupBy("class").agg(F.first("group").alias("group"), F.first("n_shingles").alias("n"), F.min("id").alias("least"), F.min("content").alias("content")), "classes"
    )
    found = written(group_pairs(docs, text, shingle, buckets, shared), "pairs")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    groups = classes.groupBy("group").agg(F.min("class").alias("lead"), F.count("*").alias("n_classes"))
    lead_a, lead_b = (groups.select(F.col("group").alias(c), F.col("lead").alias(f"lead_{c}"), F.col("n_classes").alias(f"n_{c}")) for c in "ab")
    led = written(pairs.join(lead_a, "a").join(lead_b, "b"), "led")
    several = written(classes.join(groups.where("n_classes > 1"), "group").select("group", "class", "lead", "n_classes"), "several")
    # First round: the least class of each group for its group, and with each other class of the group.
    first = written(_ordered(led.select("lead_a", "lead_b").union(several.select("class", "lead")), "lead_a", "lead_b"), "first")
    runs = found.where("kind = 1")
    in_runs = classes.join(runs.select(F.col("a").alias("group")).distinct(), "group", "left_semi").select("class")
    links, sets = _verify(docs, text, shingle, classes, first, in_runs=in_runs)
    if several.isEmpty() and runs.isEmpty():
        label = components(links, "x", "y")
    else:
        # Further rounds, only across the components of those before: the closest partners, then all that are left.
        label, tested = components(links, "x", "y"), first
        for closest in (CLOSEST, None):
            pairs = written(_across(led, several, runs, classes, label, tested, sets, closest), "across")
            more, sets = _verify(docs, text, shingle, classes, pairs, have=sets)
            links, tested = links.unionByName(more), tested.union(pairs)
            star = label.select(F.col("vertex").alias("x"), F.col("component").alias("y"))
            label = components(star.union(more.select("x", "y")), "x", "y")
        if all_links:
            pairs = written(_across(led, several, runs, classes, None, tested, sets, None), "within")
            links = links.unionByName(_verify(docs, text, shingle, classes, pairs, have=sets)[0])
    by_class = classes.join(label, F.col("class") == F.col("vertex"), "left").select("class", F.coalesce("component", "class").alias("component"), "least")
    smallest = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = by_class.join(smallest, "component").select("class", "component_id")
    out = rows.join(of_class, "class", "left").select("id", "content", "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *["class"] * all_links)
    return out, links


def _verify(docs: DataFrame, text: str, k: int, classes: DataFrame, pairs: DataFrame, *, in_runs: DataFrame | None = None, have: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links among the pairs, and the sets of the classes in them (and in ``in_runs``), beside those at hand already."""
    need = pairs.select(F.col("x").alias("class")).union(pairs.select("y"))
    if in_runs is not None:
        need = need.union(in_runs)
    need = need.distinct()
    if have is not None:
        need = need.join(have.select("class"), "class", "left_anti")
    sets = written(sets_of(docs, text, k, written(classes.join(need, "class", "left_semi").select("content"), "contents")), "sets")
    if have is not None:
        sets = have.union(sets)
    return written(verified(pairs, sets), "verified"), sets


def _across(led: DataFrame, several: DataFrame, runs: DataFrame, classes: DataFrame, label: DataFrame | None, tested: DataFrame, sets: DataFrame, closest: int | None) -> DataFrame:
    """Candidate class pairs that have not been tested, of different components (of any, without ``label``); at first only the closest.

    They are within one group, within two paired groups of which one has several classes, and within
    long runs of one token. Each is a key whose members are compared in blocks, unless all are in one component.
    """
    in_play = classes.select("group", F.col("class").alias("c"), "n")
    if label is None:
        labelled = in_play.withColumn("of_c", F.col("c"))
    else:
        labelled = in_play.join(label.select(F.col("vertex").alias("c"), F.col("component").alias("of_c")), "c", "left").withColumn("of_c", F.coalesce("of_c", "c"))
    labelled = labelled.select("group", "c", "of_c", "n")
    spread = labelled.groupBy("group").agg(F.min("of_c").alias("low"), F.max("of_c").alias("high"), F.count("*").alias("rows"))
    members_of = lambda keys: keys.join(labelled, "group").select("kind", "token", "rows", "c", "of_c", "n", "at")
    # Classes of one group.
    inner = several.select("group").distinct().join(spread.where("low <> high"), "group").select("group", F.lit(0).alias("kind"), F.col("group").alias("token"), "rows", F.lit(0).cast("long").alias("at"))
    # Classes of paired groups, where one of them has several.
    side = lambda g: spread.select(F.col("group").alias(g), *[F.col(c).alias(f"{c}_{g}") for c in ("low", "high", "rows")])
    wide = led.where("n_a > 1 or n_b > 1").select("a", "b").join(side("a"), "a").join(side("b"), "b").where("low_a <> high_a or low_b <> high_b or low_a <> low_b")
    wide = wide.select(F.explode(F.array("a", "b")).alias("group"), F.lit(1).alias("kind"), F.xxhash64("a", "b").alias("token"), (F.col("rows_a") + F.col("rows_b")).alias("rows"), F.lit(0).cast("long").alias("at"))
    # Members of long runs of one token.
    run = runs.select("token", F.col("a").alias("group"), "at")
    mixed = run.join(spread, "group").groupBy("token").agg(F.min("low").alias("p"), F.max("high").alias("q"), F.sum("rows").alias("rows")).where("p <> q").select("token", "rows")
    run = run.join(mixed, "token").select("group", F.lit(2).alias("kind"), "token", "rows", "at")
    held = members_of(inner.unionByName(wide).unionByName(run))
    return _ordered(_close(held, parity_maps(sets), closest), "x", "y").join(tested, ["x", "y"], "left_anti")


def parity_maps(sets: DataFrame) -> DataFrame:
    """(c, bits): of each bit, whether an odd number of the class's tokens falls on it."""
    schema = pa.schema([("c", pa.binary()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for c, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = (np.frombuffer(tokens, np.uint64) >> np.uint64(20)) % np.uint64(BITS)
                rows.append((c, np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()))
            yield _rows(rows, schema)

    return sets.select("class", "tokens").mapInArrow(run, "c binary, bits binary")


def _close(held: DataFrame, maps: DataFrame, closest: int | None) -> DataFrame:
    """Pairs under one key, of different components, that sizes, positions and parity maps allow to be similar enough.

    Two maps differ in no more bits than the sets differ in tokens, so no link is lost. Long keys are
    dealt out as pairs of blocks, so that no task compares more than two blocks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("kind", "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "of_c", "n", "at").join(maps, "c")
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def compare(table: pa.Table) -> pa.Table:
        c, of = table.column("c").to_pylist(), np.unique(np.array(table.column("of_c").to_pylist(), object), return_inverse=True)[1]
        n, at, own = (table.column(x).to_numpy().astype(np.int64) for x in ("n", "at", "own"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(c), -1)
        short = np.bitwise_xor.reduce(bits.reshape(len(c), 4, -1), axis=1)
        across, xs, ys = table.column("i")[0].as_py() != table.column("j")[0].as_py(), [], []
        for i in range(len(c) - 1):
            rest = slice(i + 1, None)
            total = n[i] + n[rest]
            differ = total - 2 * -(-NUM * total // (NUM + DEN))
            room = 1 + np.minimum(n[i] - at[i] - 1, n[rest] - at[rest] - 1)
            maybe = (of[rest] != of[i]) & (NUM * np.maximum(n[i], n[rest]) <= DEN * np.minimum(n[i], n[rest])) & ((NUM + DEN) * room >= NUM * total)
            if across:
                maybe &= own[rest] != own[i]
            found = i + 1 + np.flatnonzero(maybe)
            if len(found):
                found = found[np.bitwise_count(short[found] ^ short[i]).sum(1, dtype=np.int64) <= differ[found - i - 1]]
            if len(found):
                apart = np.bitwise_count(bits[found] ^ bits[i]).sum(1, dtype=np.int64)
                near = apart <= differ[found - i - 1]
                found, apart = found[near], apart[near]
                if closest is not None:
                    found = found[np.argsort(apart, kind="stable")[:closest]]
            xs += [c[i]] * len(found)
            ys += [c[f] for f in found]
        return pa.table([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], schema=schema)

    return dealt.groupBy("kind", "token", "i", "j").applyInArrow(compare, "x binary, y binary")


def deduplicated(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each component (that with the smallest id, then content, nulls last), the columns of ``docs``.

    Rows without shingles are all kept. Of repeated rows that are to be kept, one is. Columns of any name are kept.
    """
    of, number = free_name(docs, "__content"), free_name(docs, "__id")
    rows, _ = jaccard_join(docs, id=id, text=text, shingle=shingle)
    rows = written(rows, "decided")
    similar = rows.where("n_shingles > 0")
    best = similar.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "content")).alias("best"))
    kept = similar.join(best, similar["component_id"].eqNullSafe(best["component_id"])).where(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("content") == F.col("best.content")))
    kept = written(kept.groupBy("id", "content").agg(F.count("*").alias("rows")), "kept")
    gone = similar.select("id", "content").distinct().join(kept.select(F.col("id").alias("i"), F.col("content").alias("c")), F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")), "left_anti")
    mine = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumn(of, mine).withColumn(number, F.col(id).cast("long"))
    other_id, other_content = free_name(keyed, "__other_id"), free_name(keyed, "__other_content")
    match = (F.col(of) == F.col(other_content)) & F.col(number).eqNullSafe(F.col(other_id))
    named = lambda df: df.select(F.col("id").alias(other_id), F.col("content").alias(other_content))
    out = keyed.join(named(gone), match, "left_anti")
    again = named(kept.where("rows > 1"))
    if not again.isEmpty():
        once = out.join(again, match, "left_semi").dropDuplicates([number, of])
        out = out.join(again, match, "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
