"""Operator 1, n-gram Jaccard join by chosen paths.

Texts become sets of word n-grams; equal sets are one record.  A record's
sketch holds ``COORDINATES`` min-wise samples of its set: two records agree
at a coordinate with probability equal to their similarity, so an agreeing
coordinate is a sampled shared token.

* **Choosing paths.** A run starts with all records in one bucket.  Each
  bucket splits by 1 / threshold coordinates on average, chosen by a hash of
  its path; a record follows each of them to the bucket of its value there.
  Buckets of one record end, small ones are compared by brute force, and so
  are those that splitting does not thin out (their records are alike).
* **Runs.** A pass keeps a pair with a probability that falls with the
  levels it goes through and with the agreement of the sketches, which all
  runs share (``runs_for`` averages over it).  The first run goes ahead, so
  that later runs skip buckets whose records are joined already; records
  that some run splits more than ``SHALLOW`` times get more runs, until the
  target recall holds at the depth reached.
* **Brute force** compares sketches in blocks and hands on local components
  of pairs whose estimate is within reach of the threshold (the margin is
  about five standard deviations).
* **Exact check.** Inside each group of candidates all pairs are compared on
  whole n-gram sets, again in blocks, as products of incidence matrices.
  This gives exact links: each record's number of links and the components
  of the linked records.  No pair is emitted as a row.

Words are runs of characters other than ASCII white space, in lower case;
n-grams are compared by 64 bits of hash.

Defined cases: a text of fewer than n words has one n-gram of all its
words; null and empty texts have no set, link to nothing and are classes of
their own; null ids are carried, and a class id is the smallest id that is
not null; rows that share an id are rows of their own; copies (equal sets)
share all results; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.llm.common import each, materialize, pieces_for, text_key, whole_text
from vetrina.llm.exact_dedup import bloom_filter, filter_bits, filter_hits, might_contain
from vetrina.llm.graph import components
from vetrina.llm.substring_dedup import word_hashes
from vetrina.llm.windows import mix

N, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, SMALL, BLOCK, LEVELS, SHALLOW, BATCH, REMEMBERED = 64, 128, 1024, 12, 4, 12, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + _BASE)


# -- sets and sketches --------------------------------------------------

def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    h = word_hashes(text.lower().encode("utf-8", "surrogatepass").split())
    if not len(h):
        return h
    k, out = min(n, len(h)), np.zeros(max(len(h) - n + 1, 1), np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + len(out)]
    return np.unique(mix(out + np.uint64(k)))


def sketch(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        low = np.minimum(low, (mix(s[a : a + 2048])[None, :] * _A[:, None] + _B[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(n: int, id_type: str):
    schema = pa.schema([("set_key", pa.binary()), ("size", pa.int32()), ("chars", pa.int64()), ("sketch", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows = []
            for text in each(batch.column("text")):
                s = shingles(text, n)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), len(text), sketch(s)) if len(s) else (None, 0, 0, None))
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("text_key"), *made], ["row_id", "text_key", *schema.names])

    return run, f"row_id {id_type}, text_key binary, set_key binary, size int, chars long, sketch array<int>"


# -- chosen paths -------------------------------------------------------

def _children(members: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The buckets that each record of a bucket goes on to."""
    t = lambda salt, m: F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(m)).cast("int")
    one = t(1, COORDINATES)
    two = (one + 1 + t(2, COORDINATES - 1)) % COORDINATES
    extra = round(1000 * (1 / THRESHOLD - 1))
    chosen: Column = F.when(t(3, 1000) < extra, F.array(one, two)).otherwise(F.array(one))
    return (members.withColumn("c", F.explode(chosen))
            .withColumn("path", F.xxhash64("path", "c", F.element_at("sketch", F.col("c") + 1))).drop("c", *({"sketch"} - set(keep))))


def runs_for(depth: int, recall: float) -> int:
    """Runs that find a pair at the threshold with probability ``recall``
    where buckets are split ``depth`` times: the survival of a branching path,
    over the binomial agreement of one sketch."""
    agree = np.arange(COORDINATES + 1) / COORDINATES
    chance = np.array([math.comb(COORDINATES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (COORDINATES - k) for k in range(COORDINATES + 1)])
    extra, lives = 1 / THRESHOLD - 1, np.ones(COORDINATES + 1)
    for _ in range(depth):
        ends = 1 - agree * lives
        lives = 1 - (1 - extra) * ends - extra * ends**2
    runs = 1
    while (chance * (1 - lives) ** runs).sum() > 1 - recall:
        runs += 1
    return runs


def _undecided(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Without the buckets whose records are joined already."""
    own = F.coalesce("label", "set_key")
    least = live.join(labels, "set_key", "left").groupBy("path").agg(F.min(own).alias("l0"), F.max(own).alias("l1"))
    return live.join(least.where("l0 <> l1").select("path"), "path", "left_semi")


def _candidates(records: DataFrame, runs: range, name: str, labels: DataFrame | None = None) -> tuple[DataFrame, int, DataFrame | None]:
    """(a, b) edges between records of small or dense buckets whose sketches
    are alike.  ``records``: set_key, sketch; ``labels`` (set_key, label): a
    bucket whose records have one label is done.  Also the depth reached, and
    the set_key of records split more than ``SHALLOW`` times, if any."""
    start = records.select("set_key", "sketch", F.explode(F.array(*[F.lit(r).cast("long") for r in runs])).alias("path"))
    members, leaves, deep = _children(start).select("path", "set_key"), [], None
    for level in range(1, LEVELS + 1):
        shared = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        live = members.join(shared, "path")
        if labels is not None:
            live = _undecided(live, labels)
        if level == 1:  # sketches join what is left of the first split, once
            live = live.withColumn("above", F.lit(None).cast("long")).join(records.select("set_key", "sketch").hint("merge"), "set_key")
        live = materialize(live, f"{name}-level")
        dense = F.col("n") >= THRESHOLD * THRESHOLD * F.col("above")
        leaf = (F.col("n") <= SMALL) | F.coalesce(dense, F.lit(False)) | F.lit(level == LEVELS)
        leaves.append(live.where(leaf).select("path", "n", "set_key", "sketch"))
        more = live.where(~leaf)
        if more.isEmpty():
            break
        if level == SHALLOW:
            deep = more.select("set_key").distinct()
        members = _children(more.select("set_key", "path", "sketch", F.col("n").alias("above")), ("sketch",))
    found = leaves[0]
    for x in leaves[1:]:
        found = found.union(x)
    # blocks of large buckets meet pairwise; several small buckets share a group
    found = found.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    total = found.agg(F.sum("blocks")).first()[0] or 0  # rows after _block_pairs
    edges = _grouped(_block_pairs(found), ["path"], pieces_for(total, 40_000, 4), _alike, "set_key binary, sketch array<int>", "a binary, b binary")
    return edges, level, deep


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) that its block is in."""
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (rows.withColumn("block", own).withColumn("other", other)
            .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks"))


def _grouped(rows: DataFrame, keys: list[str], buckets: int, work, columns: str, out: str) -> DataFrame:
    """``work(block numbers, columns)`` for each (keys, i, j), many small
    ones in one Arrow group."""
    names = [c.split()[0] for c in columns.split(", ")]
    whole = [*keys, "i", "j"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*whole), F.lit(buckets))).select("bucket", *whole, "block", *names)
    out_names = [c.split()[0] for c in out.split(", ")]
    out_types = {"binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], out_types[c.split()[1]]) for c in out.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in whole])
        same = np.zeros(max(len(table) - 1, 0), bool)
        for c in whole:
            v = table[c].to_numpy()
            same |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(same) + 1).tolist(), len(table)]
        block, i = table["block"].to_numpy(), table["i"].to_numpy()
        done: list[tuple] = []
        for a, b in zip(edges, edges[1:], strict=False):
            columns = (table[c].slice(a, b - a) for c in names)  # only one piece is ever held as Python objects
            done += work(block[a:b] == i[a:b], bool(table["i"][a].as_py() == table["j"][a].as_py()), *(c.to_pylist() for c in columns))
        made = list(zip(*done, strict=True)) or [[] for _ in out_names]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return rows.groupBy("bucket").applyInArrow(run, out)


def _local_components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component; adjacency is symmetric."""
    label = np.arange(len(adjacent))
    while True:
        new = np.array([min(label[i], label[row].min(initial=len(label))) for i, row in enumerate(adjacent)], int)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(first, alone, keys, sketches):
    """Edges to the smallest record of a local component of alike sketches."""
    margin = 4.75 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
    least = math.floor((THRESHOLD - margin) * COORDINATES)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys = [keys[k] for k in order]
    s = np.array([sketches[k] for k in order], np.int32)
    near = np.empty((len(s), len(s)), bool)
    for a in range(0, len(s), 32):
        near[a : a + 32] = (s[a : a + 32, None, :] == s[None, :, :]).sum(2) >= least
    label = _local_components(near)
    return [(keys[i], keys[k]) for i, k in enumerate(label.tolist()) if i != k]


# -- exact links --------------------------------------------------------

def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[token] > 1  # a token of one set is in no intersection
    token, owner = np.unique(token[keep], return_inverse=True)[1], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = max(64, 8_000_000 // max(len(sets), 1))
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, [a, a + width])
        m = np.zeros((len(sets), min(width, int(token[-1]) + 1 - a)), np.float32)
        m[owner[lo:hi], token[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _links(n: int, threshold: float):
    def work(first, alone, keys, texts):
        seen = sorted({k: (f, t) for k, f, t in zip(keys, first.tolist(), texts, strict=True)}.items())
        keys, first = [k for k, _ in seen], np.array([f for _, (f, _) in seen])
        sets = [shingles(t, n) for _, (_, t) in seen]
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets).astype(np.float64)
        # intersection / union >= threshold, without division
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        label = _local_components(linked)
        if not alone:  # links inside a block are counted where it meets itself
            linked &= first[:, None] != first[None, :]
        count = linked.sum(1)
        return [(k, keys[g], c) for k, g, c in zip(keys, label.tolist(), count.tolist(), strict=True) if c or keys[g] != k]
    return work


def _first_copies(texts: DataFrame) -> DataFrame:
    """Each text once per partition (and again where memory of it ended)."""
    def run(batches):
        seen: set = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(batch.column("text_key").to_pylist()):
                if key not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))
    return texts.mapInArrow(run, "text_key binary, text string")


def _among(texts: DataFrame, member: DataFrame) -> DataFrame:
    """The texts of members, and a few others: a Bloom filter of bounded size
    keeps the rest from being shuffled."""
    bits = filter_bits(member.count())
    keys = bloom_filter(member.select(F.xxhash64("text_key").alias("h")), "h", bits)
    return might_contain(texts.withColumn("h", F.xxhash64("text_key")), "h", keys, bits).select("text_key", "text")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: id, class_id (smallest id among linked texts and copies),
    n_links (different n-gram sets of similarity ``threshold`` or more),
    n_copies (rows with the same set) and class_size (rows)."""
    return row_classes(df, id_col, text_col, n, threshold, recall).drop("text_key", "keep")


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row with the
    smallest id (null last, then smallest text hash) stays.

    Rows are told apart by id and text, not by id alone, so a text that shares
    its id with a near copy stays.  Of rows equal in both, one stays, with the
    other columns of the smallest hash.  A Bloom filter of the classes of two
    rows or more lets all other rows pass where they are read; only the rest
    is shuffled."""
    own = [F.col(f"`{c}`") for c in df.columns]
    members = materialize(row_classes(df, id_col, text_col).where("class_size > 1").select(
        F.col(f"`{id_col}`").alias("row_id"), "text_key", F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), "text_key").eqNullSafe(F.col("keep")).alias("keeps"))
        .groupBy("row_id", "text_key").agg(F.max("keeps").alias("keeps")), "class-members")
    bits = filter_bits(members.count())
    filter_ = bloom_filter(members.select(F.xxhash64("row_id", "text_key").alias("h")), "h", bits)
    rows = df.select(F.struct(*own).alias("row"), F.col(f"`{id_col}`").alias("row_id"), text_key(whole_text(text_col)).alias("text_key"))
    rows = rows.withColumn("h", F.xxhash64("row_id", "text_key"))
    block, maybe = filter_hits(rows, "h", filter_, bits)
    probed = block.withColumn("maybe", maybe)
    straight = probed.where(~F.col("maybe")).select("row.*")
    hits = probed.where("maybe").select("row", "row_id", "text_key")
    member = members.select(F.col("row_id").alias("m_id"), F.col("text_key").alias("m_key"), "keeps")
    found = hits.join(member, F.col("row_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    others = found.where("keeps is null").select("row.*")
    kept = found.where("keeps").groupBy("row_id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return straight.unionByName(others).unionByName(kept)


def row_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``jaccard_join`` with each row's text_key and its class's ``keep``: the
    first row of the class (none, id, text_key), id not null before null."""
    if threshold < THRESHOLD:
        raise ValueError(f"paths are chosen for thresholds of {THRESHOLD} or more")
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("row_id"), whole_text(text_col).alias("text")).withColumn("text_key", text_key(F.col("text")))
    run, schema = _sketches(n, id_type)
    made = materialize(rows.mapInArrow(run, schema), "sketches")
    sets = materialize(made.where("set_key is not null").groupBy("set_key").agg(
        F.min("row_id").alias("row_id"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("sketch").alias("sketch"),
        F.min(F.struct(F.col("row_id").isNull().alias("none"), F.col("row_id").alias("id"), "text_key")).alias("first"),
        F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("copies")), "sets")

    # the first run, then the others on what it has left apart, then as many
    # as the depth asks for on what goes deep
    runs = max(2, runs_for(SHALLOW, recall))
    records = sets.select("set_key", "sketch")
    edges, _, _ = _candidates(records, range(1), "run")
    groups, done = components(edges), 1
    while done < runs:
        labels = groups.select(F.col("a").alias("set_key"), F.col("b").alias("label"))
        upto = min(runs, done + BATCH)
        edges, depth, deep = _candidates(records, range(done, upto), "runs", labels)
        groups, done = components(groups.union(edges)), upto
        if deep is not None and runs < (more := runs_for(depth, recall)):
            records = materialize(records.join(deep, "set_key", "left_semi"), "deep") if runs == done else records
            runs = more

    # exact links inside each group
    member = groups.select(F.col("a").alias("set_key"), F.col("b").alias("grp")).union(groups.select("b", "b").distinct())
    member = member.join(sets.select("set_key", "text_key", "size", "chars"), "set_key")
    sized = member.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / 1_000_000)).cast("int")
    member = materialize(member.join(sized, "grp").select("grp", "set_key", "text_key", "chars", blocks.alias("blocks")), "members")
    total = member.agg(F.sum(F.col("chars") * F.col("blocks"))).first()[0] or 0  # of all copies, after _block_pairs
    member = member.drop("chars")
    texts = _first_copies(_among(rows.select("text_key", "text"), member)).join(member.hint("merge"), "text_key")
    compared = _grouped(_block_pairs(texts).withColumn("grp", F.xxhash64("grp")), ["grp"], pieces_for(2 * total, 16e6, 4), _links(n, threshold),
                        "set_key binary, text string", "set_key binary, root binary, links long")
    compared = materialize(compared, "links")
    root = components(compared.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("set_key"), F.col("b").alias("root"))
    links = compared.groupBy("set_key").agg(F.sum("links").alias("n_links"))

    classed = sets.select("set_key", "row_id", "copies", "first").join(root, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    classes = classed.groupBy("root").agg(F.min("row_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("keep"))
    each = materialize(classed.join(classes, "root").join(links, "set_key", "left").select(
        "set_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"), "class_size", "keep"), "classes")
    one = F.lit(1).cast("long")
    return made.select("row_id", "set_key", "text_key").join(each, "set_key", "left").select(
        F.col("row_id").alias(id_col), F.when(F.col("set_key").isNull(), F.col("row_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("class_size", one).alias("class_size"), "text_key", "keep")
