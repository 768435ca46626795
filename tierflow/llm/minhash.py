"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the weighted set of its word 5-grams, weighed by how often each is
found. Each element sends a Poisson process of arrivals, at a rate equal to
its weight, to random components of the signature; a component keeps the
element that came first. Two signatures agree in a component with the
probability Jaccard similarity of the texts. An element stops as soon as its
next arrival is later than the latest component.

Bands of the signature give candidates, and every candidate link between texts of
different classes is settled without an estimate:

1. by a bound. The similarity of x with any text is at most the share of x's
   weight that lies in shingles which another candidate has too, and for two texts
   whose shingles all weigh 1 at most what that leaves of the union. Shingles are
   counted over all candidates; those that stand alone bar texts and pairs
   inside the join;
2. by classes. The member of a bucket that has the most company in all its
   buckets (a group's original) is held against the others first, then the first 4;
   pairs already in one class are skipped;
3. by rare shingles. What then lies in buckets of several classes is ordered by rarity:
   two similar texts have in common at least the share ``similarity`` of either's
   weight, so the rarest shingle that they share is among the rarest of each, up to
   the rest of its weight, and for shingles that all weigh 1 the weight from there on
   must suffice for the union of both. Such shingles replace the buckets as keys; the
   members of a key's largest class are held against the others' only.

Pairs that are left are verified by exact probability Jaccard similarity, in
cells of a key, so that a text travels once for a cell and not once for a pair.

So the miss chance is that of the bands alone: 3e-5 for a pair at 0.8, less above.
Texts with equal shingles are one node from the start (128 bits of hash tell sets
apart), numbered in a written table.

Cases: a text of 1 to 4 words is one shingle of them all; a null text is an empty
one, and a wordless text is a class of its own; rows that share an id are one
document, whose class joins all their texts; rows without an id are one document
where their texts are equal, and their class id is null unless the class has an id; an
empty table gives an empty result; columns other than id and text are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.llm import textnp as T
from tierflow.llm.common import Scratch, map_batches, ship, table
from tierflow.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: P(no shared band) at similarity 0.8 is (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
HUBS = (1, 4)  # members of a bucket held against the others, before rare shingles are the keys
CELL = 64  # texts of either side of a cell, about
HELD = 4 << 20  # elements of the sets that a task keeps


def shingles(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle hash, weight) of a chunk, by doc and hash."""
    w = T.Words(buf, off)
    h = w.hashes()
    count = np.diff(w.first)
    full = np.maximum(count - k + 1, 0)
    at = T.ranges(w.first[:-1], full)
    doc = np.repeat(np.arange(len(count)), full)
    gram = T.gram_hashes(h, k)[at] if len(at) else np.zeros(0, T.U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        p = T.prefix_hash(h)
        gram = np.append(gram, T.mix(T.span_hash(p, w.first[short], w.first[short + 1]) + count[short].astype(T.U)))
        doc = np.append(doc, short)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))[: len(doc)])
    return doc[head], gram[head], np.diff(np.append(head, len(doc)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> T.U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures; a document without elements has zeros.

    All documents advance together, an arrival of each live element a round.
    """
    first = np.full(n * m, np.inf)
    sig = np.zeros(n * m, T.U)
    worst = np.full(n, np.inf)
    size = np.bincount(doc, minlength=n)
    alone = size[doc] == 1  # a single element comes first everywhere
    sig.reshape(n, m)[doc[alone]] = element[alone][:, None]
    live = np.flatnonzero(~alone)
    state, time = T.mix(element), np.zeros(len(doc))
    while len(live):
        d, s = doc[live], T.mix(state[live] + T.GAMMA)
        state[live] = s
        t = time[live] - np.log(_uniform(s)) / weight[live]
        time[live] = t
        on = t < worst[d]
        live, d, t, s = live[on], d[on], t[on], s[on]
        slot = d * m + (T.mix(s) % T.U(m)).astype(np.int64)
        better = t < first[slot]
        at, when, who = slot[better], t[better], live[better]
        order = np.lexsort((when, at))  # the earliest arrival of each component
        at, when, who = at[order], when[order], who[order]
        head = np.append(True, at[1:] != at[:-1])[: len(at)]
        first[at[head]], sig[at[head]] = when[head], element[who[head]]
        changed = np.unique(at[head] // m)
        worst[changed] = first.reshape(n, m)[changed].max(1)
    return sig.reshape(n, m)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (ascending elements, weights)."""
    (ex, wx), (ey, wy) = x, y
    common, ix, iy = np.intersect1d(ex, ey, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (wx == 1).all() and (wy == 1).all():
        return len(common) / (len(ex) + len(ey) - len(common))
    a, b = wx[ix].astype(float), wy[iy].astype(float)
    ratio = b / a
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    upto = np.searchsorted(ratio, ratio, "right")  # elements whose ratio isn't above
    sum_a, sum_b = np.append(0, np.cumsum(a)), np.append(0, np.cumsum(b))
    total = only_x + sum_a[upto] + (only_y + sum_b[-1] - sum_b[upto]) / ratio
    return float((a / total).sum())


def keys_of(doc_id: str, text: str) -> list[Column]:
    """id, t1, t2: a row's document; t1 and t2, of the text, only where there is no id."""
    own = F.col(doc_id).cast("long")
    whole = F.coalesce(F.col(text), F.lit(""))
    return [own.alias("id"), F.when(own.isNull(), F.xxhash64(whole)).otherwise(0).alias("t1"),
            F.when(own.isNull(), F.xxhash64(F.lit(1), whole)).otherwise(0).alias("t2")]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, t1, t2, of each row; f1 and f2 (hashes of the whole weighted set; null: no shingles),
    total (weight), unit (every weight is 1), bands, and z, the text as a Zstandard frame."""
    m = bands * rows

    def run(batch: pa.RecordBatch):
        pack = zstandard.ZstdCompressor(level=1)
        for lo, hi, buf, off in T.chunks(batch.column(3)):
            n = hi - lo
            doc, gram, weight = shingles(buf, off)
            sig = prob_minhash(doc, gram, weight, n, m)
            band = T.mix(sig.reshape(n * bands, rows) + T.U(1))
            key = np.zeros(n * bands, T.U)
            for r in range(rows):
                key = T.mix(key ^ band[:, r])
            key = T.mix(key + np.tile(np.arange(bands, dtype=T.U), n))
            ends = np.searchsorted(doc, np.arange(n + 1))
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(gram) + 1, T.U)
                np.cumsum(T.mix(T.mix(gram + T.U(salt)) + weight.astype(T.U)), out=total[1:])
                sums.append(T.as_long(total[ends[1:]] - total[ends[:-1]]))
            size, some = np.diff(ends), np.diff(ends) > 0
            total = np.bincount(doc, weight, n).astype(np.int64)
            yield {**{c: batch.column(i).slice(lo, n) for i, c in enumerate(("id", "t1", "t2"))},
                   "f1": pa.array(sums[0], mask=~some), "f2": pa.array(sums[1], mask=~some),
                   "total": total, "unit": total == size,
                   "bands": pa.ListArray.from_arrays(
                       pa.array(np.append(0, np.cumsum(some * bands)), pa.int32()),
                       pa.array(T.as_long(key)[np.repeat(some, bands)])),
                   "z": [pack.compress(buf[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]}

    return map_batches(docs.select(*keys_of(doc_id, text), F.col(text).alias("text")), run,
                       "id long, t1 long, t2 long, f1 long, f2 long, total long, unit boolean, bands array<long>, z binary")


def _shingled(texts: DataFrame) -> DataFrame:
    """h, node, w: the weighted shingles of node's text."""
    def run(batch: pa.RecordBatch):
        node = batch.column(0).to_numpy()
        for lo, _, buf, off in T.unpacked(batch.column(1)):
            doc, gram, weight = shingles(buf, off)
            yield {"h": T.as_long(gram), "node": node[lo + doc], "w": weight}

    return map_batches(texts.select("node", "z"), run, "h long, node long, w long")


def _alone(texts: DataFrame) -> DataFrame:
    """node and alone: the weight of its shingles that no other node of ``texts`` has."""
    once = _shingled(texts).groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).filter("n = 1")
    return once.groupBy("node").agg(F.sum("w").alias("alone"))


def rarest(weight: np.ndarray, count: np.ndarray, h: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, weight from there on) of the shingles, in order of rarity, that can be the first
    that a similar text shares; those that nobody shares are counted but left out."""
    o = np.lexsort((h, count))
    total = weight.sum()
    rest = total - (np.cumsum(weight[o]) - weight[o])
    fit = (rest >= total * (similarity * (1 - 1e-9))) & (count[o] > 1)
    return o[fit], rest[fit]


def _rare(live: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs of the nodes of ``live`` (see ``_pairs``) by their rarest shingles."""
    nodes = scratch.write(live.select("node", "comp", "total", "unit").distinct(), "nodes")
    each = scratch.write(_shingled(texts.join(nodes.select("node"), "node")), "shingles")
    often = scratch.write(each.groupBy("h").agg(F.count(F.lit(1)).alias("count")), "often")

    def run(batch: pa.RecordBatch):
        for node, at in zip(batch.column(0), range(batch.num_rows)):
            own = batch.column(1).slice(at, 1).flatten()
            h, w, count = (own.field(c).to_numpy(zero_copy_only=False) for c in ("h", "w", "count"))
            place, rest = rarest(w, count, h, similarity)
            yield {"bucket": h[place], "node": np.full(len(place), node.as_py()), "own": rest}

    whole = each.join(often, "h").groupBy("node").agg(F.collect_list(F.struct("h", "w", "count")).alias("own"))
    keyed = scratch.write(map_batches(whole, run, "bucket long, node long, own long").join(nodes, "node"), "keyed")
    scratch.drop("shingles", "often", "nodes")
    main = keyed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(
        F.max_by("comp", "c").alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("c").alias("n")).filter("classes > 1")
    keyed = scratch.write(keyed.join(scratch.write(main.drop("classes"), "main"), "bucket"), "keyed")
    scratch.trim("keyed")
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.ceil(F.col("n") / CELL))
    return _pairs(keyed, keyed.filter("comp <> main").withColumn("block", block), similarity)


def _possible(similarity: float) -> Column:
    """Whether the bound leaves a pair (own, total, unit and _own, _total, _unit) a chance."""
    t = F.lit(similarity * (1 - 1e-9))
    return ~(F.col("unit") & F.col("_unit")) | (
        (1 + t) * F.least("own", "_own") >= t * (F.col("total") + F.col("_total")))


def _pairs(live: DataFrame, hub: DataFrame, similarity: float) -> DataFrame:
    """a < b, their classes, and the cell that compares them, of the pairs of each
    bucket that are worth it; ``block`` numbers the hubs' cells."""
    h = hub.select(F.col("bucket").alias("in"), "block", *[F.col(c).alias(f"_{c}") for c in ("node", "comp", "own", "total", "unit")])
    met = live.join(h, (F.col("bucket") == F.col("in")) & (F.col("comp") != F.col("_comp")) & _possible(similarity))
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL))
    # the largest bucket of a pair is its cell
    cell = F.struct("n", F.xxhash64("bucket", "block", share).alias("at"))
    return met.groupBy(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).agg(
        F.min(F.least("comp", "_comp")).alias("ca"), F.max(F.greatest("comp", "_comp")).alias("cb"), F.max(cell).alias("cell")).select(
        "a", "b", "ca", "cb", F.col("cell.at").alias("cell"))


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """ca and cb, the classes, of the pairs (a, b, ca, cb, cell) whose texts are similar."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        cell, frames, sets, held = None, {}, {}, 0

        def weighted(node: int) -> tuple:
            nonlocal held
            if node not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                buf = np.frombuffer(unpack.decompress(frames[node]), np.uint8)
                sets[node] = shingles(buf, np.array([0, len(buf)]))[1:]
                held += len(sets[node][0])
            return sets[node]

        for batch in batches:
            cells, a, b = (batch.column(i).to_pylist() for i in range(3))
            z = batch.column(5)
            ok = np.zeros(len(a), bool)
            for i, pair in enumerate(z.is_null().to_pylist()):
                if cells[i] != cell:
                    cell, frames, sets, held = cells[i], {}, {}, 0
                if not pair:
                    frames[a[i]] = z[i].as_py()
                    continue
                ok[i] = probability_jaccard(weighted(a[i]), weighted(b[i])) >= similarity
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(ok)) for i in (3, 4)], names=["a", "b"])

    no, zero = F.lit(None).cast("binary").alias("z"), F.lit(0).cast("long")
    wanted = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = wanted.join(texts, "node").select(
        "cell", F.col("node").alias("a"), zero.alias("b"), zero.alias("ca"), zero.alias("cb"), "z")
    rows = sent.unionAll(pairs.select("cell", "a", "b", "ca", "cb", no))
    ship(pairs.sparkSession)
    # a cell's texts come before its pairs
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("z").isNull(), "a", "b").mapInArrow(
        run, "a long, b long")


def _links(rows: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float) -> DataFrame | None:
    """Edges (a, b) that join the nodes of ``sets`` into classes of similar texts."""
    placed = sets.select("node", F.explode("bands").alias("bucket"))
    # written before it is joined, so that Spark can split a hot bucket
    shared = scratch.write(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    placed = scratch.write(placed.join(shared, "bucket"), "placed")
    company = scratch.write(placed.groupBy("node").agg(F.sum("n").alias("company")), "company")
    wanted = sets.select("f1", "f2", "node").join(company.select("node"), "node")
    texts = scratch.write(rows.select("f1", "f2", "z").join(wanted, ["f1", "f2"]).groupBy("node").agg(
        F.first("z").alias("z")), "texts")
    alone = scratch.write(_alone(texts), "alone")
    own = F.col("total") - F.coalesce("alone", F.lit(0))
    able = (sets.select("node", "total", "unit").join(company, "node").join(alone, "node", "left")
            .filter(own >= F.col("total") * (similarity * (1 - 1e-9))).select("node", "company", "total", "unit", own.alias("own")))
    able = scratch.write(able, "able")
    live = scratch.write(placed.select("bucket", "node").join(able, "node").withColumn("comp", F.col("node")), "live")
    scratch.drop("shared", "placed", "company", "alone", "able")

    merged, tried = None, 0
    for hubs in (*HUBS, None):
        mixed = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
        mixed = mixed.filter((F.col("lo") < F.col("hi")) & (F.col("n") > tried)).select("bucket", "n")
        mixed = scratch.write(mixed, "mixed")
        if mixed.isEmpty():
            break
        live = scratch.write(live.drop("n").join(mixed, "bucket"), "live")
        scratch.trim("live")
        scratch.drop("mixed")
        if hubs:
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("company"), "node"))
            hub = live.withColumn("r", rank).filter(F.col("r") <= hubs).filter(F.col("r") > tried)
            hub = scratch.write(hub.withColumn("block", F.lit(0).cast("long")), "hubs")
            pairs = _pairs(live, hub, similarity)
        else:
            pairs = _rare(live, texts, scratch, similarity)
        pairs = scratch.write(pairs, "pairs")
        scratch.drop("hubs", "keyed", "main")
        found = components(_verify(pairs, texts, similarity), scratch, "classes")
        step = scratch.write(found.select(F.col("node").alias("old"), F.col("comp").alias("new")).filter("old <> new"), "steps")
        scratch.drop("pairs", "classes-labels")
        merged = step if merged is None else merged.unionAll(step)
        tried = hubs
        if hubs:
            live = scratch.write(live.join(step, live["comp"] == step["old"], "left").select(
                *[c for c in live.columns if c not in ("comp", "n")], F.coalesce("new", "comp").alias("comp")), "live")
    scratch.drop("live", "texts", "mixed")
    return merged.select(F.col("old").alias("a"), F.col("new").alias("b")) if merged is not None else None


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, t1, t2 and comp, the number of its class, of every row of docs; a document
    without words has none."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(signatures(docs, doc_id, text, bands, rows), "signed")
    sets = signed.filter("f1 IS NOT NULL").groupBy("f1", "f2").agg(
        F.first("total").alias("total"), F.first("unit").alias("unit"), F.first("bands").alias("bands"))
    sets = scratch.write(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    edges = _links(signed, sets, scratch, similarity)
    slim = signed.select("id", "t1", "t2", "f1", "f2").join(sets.select("f1", "f2", "node"), ["f1", "f2"], "left")
    slim = scratch.write(slim.select("id", "t1", "t2", "node"), "rows")
    scratch.drop("signed", "sets")
    # the texts of a repeated id belong together, and so does a wordless one
    of_id = scratch.write(slim.filter("id IS NOT NULL AND node IS NOT NULL").groupBy("id").agg(
        F.min("node").alias("first"), F.max("node").alias("last")), "ids")
    several = of_id.filter("first < last").select("id", "first")
    ties = slim.join(several, "id").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    every = components(ties if edges is None else edges.unionAll(ties), scratch, "final")
    lost = slim.filter("node IS NULL").join(of_id.select("id", "first"), "id", "left").select(
        "id", "t1", "t2", F.col("first").alias("node"))
    out = slim.filter("node IS NOT NULL").unionAll(lost).join(every, "node", "left").select(
        "id", "t1", "t2", F.coalesce("comp", "node").alias("comp"))
    out = scratch.write(out, "classes")
    scratch.drop("rows", "ids", "final-labels", "steps")
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, a row per row of docs."""
    found = classes(docs, doc_id, text, similarity, bands, rows)
    least = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"))
    return found.join(least, "comp", "left").select(
        F.col("id").alias(doc_id), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("class_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, the one of smallest id (without
    any: of least key), and one row of that document."""
    scratch = Scratch(docs.sparkSession, "one")
    found = classes(docs, doc_id, text)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    counted = found.groupBy("id", "t1", "t2").agg(F.min("comp").alias("comp"), F.count(F.lit(1)).alias("rows"))
    least = counted.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(own).alias("one"))
    counted = counted.join(least, "comp", "left").withColumn("stays", F.col("one").isNull() | (F.col("one") == own))
    # what goes, and what stays but has several rows, is less than what stays
    apart = scratch.write(counted.filter("NOT stays OR rows > 1").select(
        F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "stays"), "apart")
    row = docs.select(F.struct("*").alias("row"), *keys_of(doc_id, text))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    out = row.join(apart, same, "left_anti").select("row.*")
    repeated = apart.filter("stays")
    if repeated.isEmpty():
        return out
    return out.unionAll(row.join(repeated, same, "left_semi").dropDuplicates(["id", "t1", "t2"]).select("row.*"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "class_id")
