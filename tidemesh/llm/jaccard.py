"""Exact similarity join of shingle sets by filters under several global token orders.

Equal sets form a class first; below, a document stands for its class. With a threshold of 0.8, linked sets of
n tokens share at least ceil(0.8 n), so under any global order of tokens they have a token in common among
their first n - ceil(0.8 n) + 1, the prefix. The first order puts rare tokens first, which makes its filter sharp:

* Tokens below a bound of their hash come first, by the times the corpus uses them; the rest follow by hash.
  So only a fixed share of all tokens has to be counted. Tokens of a single class match nothing; a document whose
  prefix holds no others is done. Passages that many documents share stay out of the prefixes.
* The second and third order are by hashes of the tokens that have nothing to do with their use or with one another (``orders``).

Candidates aren't spelled out as all pairs of a token's documents. Documents with a prefix token in common and of one
range of sizes (linked ones differ by a quarter at most) form a group, which has a pivot, its document with the
fewest tokens of its own; everything is compared with its pivot first. Documents that are thereby in one
component need no comparison with each other. For the rest, let D(u) be the pivot's tokens that u lacks and E(u) the tokens it has
besides. With s tokens lacking in both and e besides in both, u and v are linked iff

    (100 + p) (s + e) >= A(u) + A(v) + (100 - p) |pivot|,   A(u) = 100 |D(u)| + p |E(u)| - (100 - p) |pivot|.

A(u) <= 0 says that u is linked with the pivot itself. As s is at most the smaller of |D(u)| and |D(v)|, that needs

    (100 + p) e >= A(u) + c(v),   c(v) = p (|E(v)| - |D(v)|).

So u, where it isn't linked with the pivot, can only be linked with a v of c(v) >= 0 if they share A(u) / (100 + p) of
their E: a join on tokens again, of which the rarest in the group make a prefix. Few v have c(v) < 0 (texts cut short). They
are found by any common E or, having none, by A(u) / p common D, in a prefix as well (``candidates``). Only
candidates that share prefix tokens under all three orders are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemesh.llm import kernel as K
from tidemesh.llm.spans import NO_ID, ROW, keyed
from tidemesh.llm.store import scratch, stored

SPAN = 5
#: Similarity in hundredths.
PERCENT = 80
#: Share of tokens, by hash, that is ordered by use.
COUNTED = 0.3
#: Documents to fetch the sets of by a broadcast of their ids; with more of them the join is shuffled.
BROADCAST_IDS = 2_000_000
#: Bytes of a token that comparisons use.
TOKEN_BYTES = 6


def shingles(text: pa.Array, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, where each text's begin): the distinct shingles' hashes of each text, ascending."""
    w = K.Words(text, lower=True)
    rolling = K.Rolling(w.hashes(), K.BASES[1])
    n = len(w.first) - 1
    grams = rolling.grams(span)
    of = w.owner()
    whole = np.flatnonzero(of[: len(grams)] == of[span - 1 :][: len(grams)])
    short = np.flatnonzero((w.counts > 0) & (w.counts < span))
    h = np.concatenate([grams[whole], rolling.ranges(w.first[short], w.first[short + 1])])
    owner = np.concatenate([of[whole], short])
    order = K.grouped_order(h, owner, n)
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.searchsorted(owner[first], np.arange(n + 1))


def class_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(K.mix(tokens * np.uint64(0xD1342543DE82EF95)), out=total[1:])
    size = np.diff(first).astype(np.uint64)
    return K.mix((total[first[1:]] - total[first[:-1]]) ^ K.mix(size + np.uint64(1)))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-n * percent) // 100 + 1


def counted(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each set's tokens are below the bound."""
    return K.sums_by(first, tokens < np.uint64(int(COUNTED * 2**64)))


def members(docs: DataFrame, span: int, percent: int) -> DataFrame:
    """ROW, n, low (counted tokens), set (its class; null without words) and ordered of each document.

    ordered: the counted tokens; where they don't fill the prefix, the next ones by hash as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.blocks(batch):
                tokens, first = shingles(text, span)
                n = np.diff(first)
                low = counted(tokens, first)
                most = np.where(n > 0, np.maximum(low, prefix(n, percent)), 0)
                ends = np.cumsum(most)
                at = np.repeat(first[:-1] - (ends - most), most) + np.arange(ends[-1] if len(ends) else 0)
                ordered = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(K.signed(tokens[at])))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(n), pa.array(low), pa.array(K.signed(class_keys(tokens, first)), mask=n == 0), ordered], names=[*ROW, "n", "low", "set", "ordered"])

    return docs.mapInArrow(run, "did long, th long, tag long, n long, low long, set long, ordered array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """set, n, tokens (TOKEN_BYTES each, ascending) of the documents ``wanted`` (did) names."""
    wanted = wanted.distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    held = docs.join(wanted, "did")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text in K.blocks(batch):
                tokens, first = shingles(text, span)
                raw = packed(tokens >> np.uint64(64 - 8 * TOKEN_BYTES))
                blobs = [raw[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(class_keys(tokens, first))), pa.array(np.diff(first)), pa.array(blobs, type=pa.binary())], names=["set", "n", "tokens"])

    return held.mapInArrow(run, "set long, n long, tokens binary").dropDuplicates(["set"])


def packed(tokens: np.ndarray) -> np.ndarray:
    """The tokens' TOKEN_BYTES low bytes, a row each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, where each row's begin) of a binary column."""
    column = column.cast(pa.large_binary())
    data, offsets = K.buffers(column)
    raw = np.zeros((len(data) // TOKEN_BYTES, 8), dtype=np.uint8)
    raw[:, :TOKEN_BYTES] = data.reshape(-1, TOKEN_BYTES)
    return raw.view("<u8").ravel(), offsets // TOKEN_BYTES


def compared(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool) -> DataFrame:
    """a, b, n_a, n_b, both (tokens in common) of the pairs a, b; with ``differences`` also extra (a's tokens besides) and missing (b's that a lacks).

    missing is only given where candidates() looks for it: where a isn't similar to b, or lacks more than it has besides.
    """
    side = lambda c: sets.select(F.col("set").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    joined = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "tokens_a", "tokens_b")
    bits = np.uint64(8 * TOKEN_BYTES)

    def cuts(tokens: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> pa.Array:
        raw, at = packed(tokens), np.concatenate([[0], np.cumsum(n)])
        return pa.array([raw[i:j].tobytes() if x else None for i, j, x in zip(at[:-1].tolist(), at[1:].tolist(), wanted.tolist(), strict=True)], type=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.portions(batch, (2, 3)):
                m = part.num_rows
                (x, fx), (y, fy) = unpacked(part.column(2)), unpacked(part.column(3))
                na, nb = np.diff(fx), np.diff(fy)
                row = np.concatenate([np.repeat(np.arange(m), c) for c in (na, nb)]).astype(np.uint64)
                key = (row << bits) | np.concatenate([x, y])
                # a's tokens come first among equals, as the sort is stable.
                order = np.argsort(key, kind="stable")
                key = key[order]
                same = np.flatnonzero(key[1:] == key[:-1])
                both = np.bincount((key[same] >> bits).astype(np.int64), minlength=m)
                columns = [part.column(0), part.column(1), pa.array(na), pa.array(nb), pa.array(both)]
                if differences:
                    hit = np.zeros(len(key), dtype=bool)
                    hit[order[same]] = hit[order[same + 1]] = True
                    lacks, besides = nb - both, na - both
                    far = (100 * lacks + percent * besides > (100 - percent) * nb) | (besides < lacks)
                    columns += [cuts(x[~hit[: len(x)]], besides, np.ones(m, dtype=bool)), cuts(y[~hit[len(x) :]], lacks, far)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_a", "n_b", "both", "extra", "missing"][: len(columns)])

    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, both long" + (", extra binary, missing binary" if differences else ""))


def candidates(found: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of documents compared with one pivot (``found``) that may be linked and aren't known to be in one component (``roots``), see above."""
    whole, rest = 100 + percent, 100 - percent
    of = lambda c: roots.select(F.col("set").alias(c), F.col("root").alias(f"root_{c}"))
    side = found.hint("merge").join(of("a"), "a", "left").hint("merge").join(of("b"), "b", "left")
    side = side.select(
        F.col("a").alias("set"),
        F.col("b").alias("pivot"),
        F.col("n_a").alias("n"),
        "n_b",
        (F.col("n_b") - F.col("both")).alias("lacks"),
        (F.col("n_a") - F.col("both")).alias("besides"),
        F.coalesce("root_a", "a").alias("root"),
        (F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).alias("apart"),
        "extra",
        "missing",
    )
    side = side.withColumn("needs", F.expr(f"100 * lacks + {percent} * besides - {rest} * n_b")).withColumn("thin", F.expr("besides < lacks"))
    # Documents that are apart from the pivot look for partners; of two partners in different components at least one is.
    side = stored(side.withColumn("seeks", F.expr("needs > 0 AND apart")).drop("apart"), "sides")
    pivots = stored(side.filter("seeks").select("pivot").distinct(), "open-pivots")
    side = side.hint("merge").join(pivots, "pivot")
    kept = ("set", "pivot", "n", "n_b", "lacks", "needs", "root", "thin", "seeks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept, "token", "has"]
        for batch in batches:
            places = batch.schema.get_field_index("extra"), batch.schema.get_field_index("missing")
            for part in K.portions(batch, places, 1 << 17):
                for column, has in zip(places, (True, False), strict=True):
                    token, first = unpacked(pc.fill_null(part.column(column).cast(pa.large_binary()), b""))
                    take = pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).take(take) for c in kept), pa.array(token.astype(np.int64)), pa.array(np.full(len(token), has))], names=names)

    types = ", ".join(f"{c} {'boolean' if c in ('thin', 'seeks') else 'long'}" for c in kept)
    rows = side.select(*kept, "extra", F.when(F.col("thin") | F.col("seeks"), F.col("missing")).alias("missing")).mapInArrow(run, f"{types}, token long, has boolean")
    shared = rows.groupBy("pivot", "token", "has").agg(F.count(F.lit(1)).alias("times"), F.max("seeks").alias("sought")).filter("times > 1 AND sought").drop("sought")
    rows = rows.hint("merge").join(stored(shared, "differences-shared"), ["pivot", "token", "has"])
    own = Window.partitionBy("set", "pivot", "has")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("times", "token"))).withColumn("shared", F.count(F.lit(1)).over(own))
    rows = stored(rows.withColumn("e", F.when(F.col("has"), F.col("shared")).otherwise(0)).drop("times"), "differences")
    # What pairs meet by: 0: E, partners with c >= 0; 1: E, partners with c < 0; 2: D, partners with c < 0.
    by_e = F.expr(f"has AND rank <= shared - (needs + {whole - 1}) div {whole} + 1")
    by_d = F.expr(f"NOT has AND rank <= shared - (needs + {percent - 1}) div {percent} + 1")
    seeking = rows.filter("seeks").withColumn("way", F.explode(F.array_compact(F.array(F.when(by_e, 0), F.when(F.col("has"), 1), F.when(by_d, 2)))))
    found_by = rows.filter("has OR thin").withColumn("way", F.expr("if(has, if(thin, 1, 0), 2)"))
    other = found_by.select("pivot", "token", "way", *(F.col(c).alias(f"o_{c}") for c in ("set", "n", "lacks", "needs", "root", "seeks", "e")))
    may = F.expr(
        f"root != o_root AND (NOT o_seeks OR set < o_set) AND 100 * least(n, o_n) >= {percent} * greatest(n, o_n)"
        f" AND {whole} * (least(lacks, o_lacks) + least(e, o_e)) >= needs + o_needs + {rest} * n_b"
    )
    met = seeking.select("pivot", "token", "way", "set", "n", "n_b", "lacks", "needs", "root", "e").hint("merge").join(other, ["pivot", "token", "way"]).filter(may)
    return met.select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b")).distinct()


def orders(sets: DataFrame, percent: int) -> DataFrame:
    """set, second, third: the prefixes of sets under two orders by hashes of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.portions(batch, (1,)):
                token, first = unpacked(part.column(1))
                n = np.diff(first)
                owner, most = np.repeat(np.arange(len(n)), n), prefix(n, percent)
                columns = [part.column(0)]
                for seed in (2, 3):
                    key = K.seeded(token, seed)
                    order = np.lexsort((key, owner))
                    rank = np.arange(len(order)) - first[:-1][owner]
                    chosen = order[rank < most[owner]]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(most, n))]), type=pa.int32()), pa.array(token[chosen].astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["set", "second", "third"])

    return sets.select("set", "tokens").mapInArrow(run, "set long, second array<long>, third array<long>")


def intersected(pairs: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that share prefix tokens under all three orders."""
    ends = stored(pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct(), "ends")
    prefixes = orders(sets.hint("merge").join(ends, "set"), percent)
    prefixes = prefixes.hint("merge").join(first.hint("merge").join(ends, "set").groupBy("set").agg(F.collect_list("token").alias("first")), "set")
    prefixes = stored(prefixes, "prefixes")
    side = lambda c: prefixes.select(F.col("set").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("first", "second", "third")))
    joined = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return joined.filter(" AND ".join(f"arrays_overlap({x}_a, {x}_b)" for x in ("first", "second", "third"))).select("a", "b")


def components(links: DataFrame, name: str) -> DataFrame:
    """set, root for every end of the links: roots are the least set of each component.

    Each round takes the least root among a set's own and its neighbours', then that root's root; a component of
    diameter d is done in about log d rounds.
    """
    with scratch(links.sparkSession) as tables:
        both = links.select("a", "b").union(links.select("b", "a")).distinct()
        both = stored(both, f"{name}-links")
        roots = both.groupBy(F.col("a").alias("set")).agg(F.min("b").alias("near")).select("set", F.least("set", "near").alias("root"))
        roots = stored(roots, f"{name}-roots")
        while True:
            with scratch(links.sparkSession) as round_:
                own = roots.select(F.col("set").alias("b"), "root")
                near = both.hint("merge").join(own, "b").groupBy(F.col("a").alias("set")).agg(F.min("root").alias("near"))
                hooked = roots.withColumnRenamed("root", "old").join(near, "set").withColumn("root", F.least("old", "near"))
                # A root that saw a smaller one takes it along for all that point to it. Lookups are from stored tables, so that Spark can split a root that very many point to.
                hooked = stored(hooked.select("set", "old", "root"), f"{name}-hooked")
                moved = stored(hooked.filter("root < old").groupBy("old").agg(F.min("root").alias("via")), f"{name}-moved")
                new = stored(hooked.hint("merge").join(moved, "old", "left").select("set", "old", F.least("root", "via").alias("root")), f"{name}-via")
                jump = new.select(F.col("set").alias("root"), F.col("root").alias("further"))
                new = round_.keep(new.hint("merge").join(jump, "root", "left").select("set", "old", F.coalesce("further", "root").alias("root")), f"{name}-roots")
            roots = new.select("set", "root")
            if new.filter("root < old").isEmpty():
                return tables.keep(roots, f"{name}-components")


def join(docs: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each document.

    Null texts and texts without words have no shingles and are linked with nothing; with fewer words than a shingle the
    words are one. A null doc_id comes after all others and is kept as null. Rows with one doc_id are documents of
    their own. Other columns are ignored. Shingles count as equal by a 64-bit hash. Of an empty table the result is empty. A text
    is read whole by one task, which needs about 100 bytes of memory for each of its bytes.
    """
    out = grouped(docs, span, percent)
    return out.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def grouped(docs: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """ROW (see spans.keyed()), n, root and component of each row, see join().

    Rows are linked if and only if they have one root, also where ids are shared; it is null without words.
    """
    with scratch(docs.sparkSession) as tables:
        keys = keyed(docs)
        table = tables.keep(members(keys, span, percent), "members")
        classes = table.filter("set IS NOT NULL").groupBy("set").agg(F.min("did").alias("did"), F.max("n").alias("n"), F.max("low").alias("low"))
        rows = table.select(F.explode("ordered").alias("token"), "set")
        shared = rows.groupBy("token").agg(F.min("set").alias("least"), F.max("set").alias("most"), F.count(F.lit(1)).alias("times")).filter("least < most").select("token", "times")
        # Stored, so that both sides of the join are plain shuffles, which Spark splits where a token is very frequent; likewise below.
        shared = stored(shared, "tokens")
        held = stored(rows.hint("merge").join(shared, "token").select("token", "set", "times").distinct(), "shared")

        bound = int(COUNTED * 2**64)
        # As signed longs, tokens below the bound are those of an unsigned value below it.
        below = F.expr(f"token >= 0 AND token < {bound}L")
        own = held.groupBy("set").agg(F.count_if(below).alias("low_shared"))
        size = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
        left = own.join(classes, "set").withColumn("unique", F.col("low") - F.col("low_shared")).withColumn("room", size - F.col("unique")).filter("room > 0")
        left = stored(left.select("set", "did", "n", "unique", "room"), "left")
        kept = held.withColumn("low", below).hint("merge").join(left, "set")
        rank = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("low"), F.when(F.col("low"), F.col("times")).otherwise(0), "token"))
        first = stored(kept.withColumn("rank", rank).filter("NOT low OR rank <= room").select("token", "set", "n", "did", "unique"), "first")
        sets = stored(sets_of(keys, left.select("did"), span), "sets")

        # Sizes of linked documents are in one range or in neighbouring ones; each document is in its own and in the next one's group.
        ranged = F.floor(F.log("n") / float(np.log(max(100 / percent, 1.05) * (1 + 1e-9)))).cast("int")
        groups = first.withColumn("range", F.explode(F.array(ranged, ranged + 1)))
        pivots = groups.groupBy("token", "range").agg(F.min_by("set", F.struct("unique", "did", "set")).alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
        pivots = stored(pivots, "pivots")
        placed = groups.hint("merge").join(pivots, ["token", "range"]).filter(F.col("set") != F.col("pivot"))
        star = placed.select(F.col("set").alias("a"), F.col("pivot").alias("b")).distinct()
        found = stored(compared(star, sets, percent, True), "compared")
        similar = f"100 * both >= {percent} * (n_a + n_b - both)"
        links = stored(found.filter(similar).select("a", "b"), "links")
        rest = stored(candidates(found, components(links, "star"), percent), "candidates")
        more = compared(stored(intersected(rest, first, sets, percent), "rest"), sets, percent, False).filter(similar).select("a", "b")
        roots = components(stored(links.union(more), "all-links"), "all")

        by_class = classes.select("set", "did").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        by_class = stored(by_class, "classes")
        smallest = stored(by_class.groupBy("root").agg(F.min("did").alias("component")), "smallest")
        by_class = tables.keep(by_class.hint("merge").join(smallest, "root").select("set", "root", "component"), "components")
    out = table.hint("merge").join(by_class, "set", "left")
    return out.select(*ROW, "n", "root", F.coalesce("component", "did").alias("component"))
