"""Retrieval: exact vector search, evidence routing, handles, BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import parts_of, written

#: Queries of about so many bytes at most go out in a broadcast; more meet the items in tasks of up to so many queries and items.
QUERY_BYTES, QUERY_STRIPE, ITEM_STRIPE = 2 << 20, 1 << 15, 1 << 18
#: Queries times k that a task keeps, queries compared at once, rows that make a stripe of their own worth its copies.
KEPT, QUERY_BLOCK, WORTH = 4 << 20, 1024, 4096
#: Found rows of so many at most are sent to the tables they are read from.
SENT_ROWS = 2_000_000
#: Digits of a similarity that count; equal vectors then tie whatever the order of summation.
DIGITS = 9


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as unit rows; a zero, null or empty vector is a row of zeros."""
    n = len(vectors)
    if vectors.null_count == 0 and n:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) % n == 0 and len(set(np.unique(pa.compute.list_value_length(vectors).to_numpy()))) == 1:
            return _unit(flat.reshape(n, -1))
    rows = [v.as_py() or [] for v in vectors]
    dim = max(map(len, rows), default=0)
    return _unit(np.array([r or [0.0] * dim for r in rows], np.float64).reshape(n, dim))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest per row, the first columns on a tie, without -inf."""
    if sims.shape[1] > k:
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k][:, None]
        above, tie = sims > least, sims == least
        keep = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True)))
    else:
        keep = np.ones(sims.shape, bool)
    return np.nonzero(keep & (sims > -np.inf))


class _Top:
    """The k best (item, similarity) of every query so far; ties go to the least id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows, self.at, self.sims = k, [], [], []
        self.names, self.named = [], 0  # ids of the items met, by which ``at`` counts
        self.held, self.most, self.least = 0, max(1 << 20, 3 * n * k), np.full(n, -np.inf)

    def add(self, at: int, sims: np.ndarray) -> None:
        """Similarities of the queries from ``at`` on to the items named last, in the order of their ids; -inf where they do not meet."""
        least = self.least[at : at + len(sims)]
        if np.isneginf(least).any():
            sims = np.round(sims, DIGITS)
            r, c = _best(sims, self.k)
            found = sims[r, c]
        else:
            r, c = np.nonzero(sims >= (least - 2 * 10.0**-DIGITS)[:, None])
            found = np.round(sims[r, c], DIGITS)
        if len(r):
            self.rows.append((r + at).astype(np.int32)), self.at.append((c + self.named).astype(np.int32)), self.sims.append(found)
            self.held += len(r)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, similarity) of the k best so far; forgets the others and their names."""
        if not self.rows:
            self.names, self.named = [], 0
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        r, at, sims, names = (np.concatenate(x) for x in (self.rows, self.at, self.sims, self.names))
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        order = np.lexsort((rank[at], -sims, r))
        r, at, sims = r[order], at[order], sims[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        full = nth == self.k - 1
        self.least[r[full]] = sims[full]
        keep = nth < self.k
        r, at, sims = r[keep], at[keep], sims[keep]
        used, at = np.unique(at, return_inverse=True)
        names = names[used]
        self.rows, self.at, self.sims, self.held = [r], [at.astype(np.int32)], [sims], len(r)
        self.names, self.named = [names], len(names)
        return r, names[at], sims

    def meet(self, q: np.ndarray, qids: np.ndarray, own: np.ndarray, vectors: pa.Array, skip_self: bool, apart: np.ndarray | None = None) -> None:
        """Compare all queries with a batch of items; ``apart`` marks pairs that do not meet."""
        order = np.argsort(own, kind="stable")
        own, v = own[order], _matrix(vectors)[order]
        if v.shape[1] != q.shape[1]:  # only empty vectors here or there
            q, v = (m if m.shape[1] else np.zeros((len(m), max(q.shape[1], v.shape[1]))) for m in (q, v))
        self.names.append(own)
        for i in range(0, len(qids), QUERY_BLOCK):
            some = slice(i, i + QUERY_BLOCK)
            sims = q[some] @ v.T
            if apart is not None:
                sims[apart[some][:, order]] = -np.inf
            if skip_self:
                sims[qids[some][:, None] == own[None, :]] = -np.inf
            self.add(i, sims)
        self.named += len(own)
        if self.held > self.most or np.isneginf(self.least).any():
            self.cut()

    def batches(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, ids, sims = self.cut()
        for at in range(0, len(r), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(qids[r[some]]), pa.array(ids[some]), pa.array(sims[some])], ["qid", "id", "raw"])


def _column(c: pa.Array) -> np.ndarray:
    """Ids as numbers or as text of fixed width, which sorts and compares fast."""
    found = c.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def nearest(queries: DataFrame, items: DataFrame, k: int, within: str | None = None, skip_self: bool = False, k_of: str | None = None) -> DataFrame:
    """(qid, id, raw, rank): the k items with the greatest cosine to every query, ties by id.

    ``queries`` has qid and vector, ``items`` id and vector; with ``within`` both have that column and
    only equal values meet. A few queries go out in one broadcast to every task of the items. More are
    dealt with the items into cells of (value of ``within``, stripe of queries, stripe of items), none of
    which sees the driver; a cell holds its queries and lets its items stream by. Either way blocks are
    compared by matrix products and a task sends on its own k best. Zero vectors are like nothing (0).
    """
    spark = items.sparkSession
    kind = dict(queries.dtypes)["qid"], dict(items.dtypes)["id"]
    group = [within] if within else []
    asked, held = queries.select("qid", "vector", *group), items.select("id", "vector", *group)
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(64 + 8 * F.size("vector")), F.lit(0))).first()
    if n * k <= KEPT and size <= QUERY_BYTES:
        found = _from_broadcast(asked, held, k, within, skip_self, kind)
    else:
        found = _from_cells(asked, held, k, within, skip_self, kind)
    if n == 0:
        return spark.createDataFrame([], f"qid {kind[0]}, id {kind[1]}, raw double, rank int")
    by = Window.partitionBy("qid").orderBy(F.desc("raw"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _from_broadcast(queries: DataFrame, items: DataFrame, k: int, within: str | None, skip_self: bool, kind: tuple[str, str]) -> DataFrame:
    block = queries.orderBy("qid").collect()
    dim = max((len(r["vector"] or ()) for r in block), default=0)
    q = _unit(np.array([r["vector"] or [0.0] * dim for r in block], np.float64).reshape(len(block), dim))
    shared = items.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in block]), q, np.array([r[within] for r in block]) if within else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, groups = shared.value
        top = _Top(len(qids), k)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                apart = groups[:, None] != part.column(2).to_numpy(zero_copy_only=False)[None, :] if groups is not None else None
                top.meet(q, qids, _column(part.column(0)), part.column(1), skip_self, apart)
        yield from top.batches(qids)

    return items.mapInArrow(run, f"qid {kind[0]}, id {kind[1]}, raw double")


def _from_cells(queries: DataFrame, items: DataFrame, k: int, within: str | None, skip_self: bool, kind: tuple[str, str]) -> DataFrame:
    group = [within] if within else []
    stripe, least = max(1, min(QUERY_STRIPE, KEPT // k)), 2 if within else 8
    parts = lambda n, each: F.greatest(F.ceil(F.col(n) / each), F.least(F.lit(least), F.ceil(F.col(n) / WORTH))).cast("int")
    sizes = lambda df, n: df.groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    cells = sizes(queries, "nq").join(sizes(items, "ni"), group) if within else sizes(queries, "nq").crossJoin(sizes(items, "ni"))
    cells = cells.select(*group, parts("nq", stripe).alias("qs"), parts("ni", ITEM_STRIPE).alias("js"))
    first = F.sum(F.col("qs") * F.col("js")).over(Window.orderBy(*(group or [F.lit(0)]))) - F.col("qs") * F.col("js")  # a row per group
    cells = F.broadcast(written(cells.withColumn("first", first.cast("int")), "cells").filter("js > 0"))
    many = cells.agg(F.sum(F.col("qs") * F.col("js"))).first()[0] or 1
    doubles = F.col("vector").cast("array<double>").alias("vector") if dict(queries.dtypes)["vector"] != dict(items.dtypes)["vector"] else F.col("vector")
    own = lambda df, key, n: df.withColumn("_own", F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
    met = lambda df: df.join(cells, group) if within else df.crossJoin(cells)
    null = lambda i: F.lit(None).cast(kind[i])
    q = own(met(queries), "qid", "qs").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
    q = q.select((F.col("first") + F.col("_own") * F.col("js") + F.col("j")).alias("cell"), F.lit(0).alias("side"), F.col("qid"), null(1).alias("id"), doubles)
    i = own(met(items), "id", "js").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    i = i.select((F.col("first") + F.col("q") * F.col("js") + F.col("_own")).alias("cell"), F.lit(1).alias("side"), null(0).alias("qid"), "id", doubles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, the queries before the items."""
        cell, asked, top, qids = None, [], None, None
        for b in batches:
            marks = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            ends = [*(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for start, end in zip([0, *ends], ends, strict=False):
                part = b.slice(start, end - start)
                if cell != marks[start] // 2:
                    if top:
                        yield from top.batches(qids)
                    cell, asked, top = marks[start] // 2, [], None
                if marks[start] % 2 == 0:
                    asked.append((_column(part.column(2)), _matrix(part.column(4))))
                    continue
                if top is None and asked:
                    qids, dim = np.concatenate([x for x, _ in asked]), max(m.shape[1] for _, m in asked)
                    q = np.concatenate([m if m.shape[1] else np.zeros((len(m), dim)) for _, m in asked])
                    asked, top = [], _Top(len(qids), k)
                for at in range(0, part.num_rows if top else 0, 4096):
                    some = part.slice(at, 4096)
                    top.meet(q, qids, _column(some.column(3)), some.column(4), skip_self)
        if top:
            yield from top.batches(qids)

    dealt = q.unionByName(i).repartitionById(many, "cell").sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(run, f"qid {kind[0]}, id {kind[1]}, raw double")


def met_by(found: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a large table joined to rows found in it; found rows are written, and sent to the table while they are few."""
    found = written(found, "found")
    return table.join(F.broadcast(found) if found.count() <= SENT_ROWS else found, key)


def search(queries: DataFrame, chunks: DataFrame, k: int, corpus: str, reference: int = 800, exempt: tuple[str, ...] = ("availability",)) -> DataFrame:
    """Chunk search: 5k nearest over all corpora, then the corpus filter, length damping and the best k.

    ``chunks`` has id, vector, corpus, section_type and n_chars. Fewer than k rows may be left.
    """
    found = met_by(nearest(queries, chunks, 5 * k), chunks.filter(F.col("corpus") == corpus).select("id", "section_type", "n_chars"))
    damped = F.when(F.col("section_type").isin(*exempt), F.lit(1.0)).otherwise(T.length_damping(F.col("n_chars"), reference))
    found = found.withColumn("score", F.round(F.col("raw") * damped, DIGITS))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("qid", "id", "raw", "score", "rank")


def route_chunks(hits: DataFrame, papers: DataFrame, per_paper: int = 4) -> DataFrame:
    """Of ranked hits (qid, id, paper, rank), the best ``per_paper`` of each reached (qid, paper)."""
    by = Window.partitionBy("qid", "paper").orderBy("rank")
    return hits.join(papers.select("qid", "paper").distinct(), ["qid", "paper"], "left_semi").withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= per_paper)


def with_handles(hits: DataFrame) -> DataFrame:
    """Number each query's papers P1, P2, ... by first appearance in rank order."""
    first = hits.withColumn("first", F.min("rank").over(Window.partitionBy("qid", "paper")))
    return first.withColumn("handle", F.concat(F.lit("P"), F.dense_rank().over(Window.partitionBy("qid").orderBy("first")))).drop("first")


def evidence(hits: DataFrame, text: str = "text") -> DataFrame:
    """One evidence text per query: blocks in rank order under their handles, a blank line between."""
    block = F.concat(F.lit("["), F.col("handle"), F.lit("] "), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("evidence"), F.count_distinct("paper").alias("n_papers"))


def merge_hits(batches: DataFrame) -> DataFrame:
    """Hits of several retrievals (qid, batch, rank, id): each chunk once, in the order first seen."""
    firsts = batches.groupBy("qid", "id").agg(F.min(F.struct("batch", "rank")).alias("seen"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("seen", "id"))).select("qid", "id", "rank")


#: Distinct query terms that filter inside a document's array; with more, terms meet in a semi-join.
MOST_TERMS = 20_000


def _held_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, dl, term, tf): for every document a row with its number of terms (term null), and its counts of the wanted terms.

    The wanted terms are counted first. While they are few they filter each document's array, so only
    what a query asks for becomes rows; otherwise all terms do and meet them in a semi-join.
    """
    distinct = wanted.select("term").distinct()
    terms = docs.select("id", T.search_terms(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), "t")
    if distinct.count() <= MOST_TERMS:
        asked = [r.term for r in distinct.collect()]
        terms = terms.withColumn("t", F.filter("t", lambda x: x.isin(asked)))
        return terms.select("id", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = terms.select("id", "dl", F.explode("t").alias("term")).join(distinct, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return rows.unionByName(terms.select("id", "dl", F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("tf")))


def bm25(docs: DataFrame, queries: DataFrame, limit: int = 12, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, score, rank) for docs (id, text) and queries (qid, text).

    Terms meet in an equi-join on the term; df and length are aggregates over all documents.
    """
    wanted = written(queries.select("qid", F.explode(T.search_terms(F.col("text"))).alias("term")).distinct(), "wanted")
    held = written(_held_terms(docs, wanted), "terms")  # terms are found once; what follows reads a narrow table
    total = held.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    held = held.filter("term is not null")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = held.join(df, "term").join(wanted, "term").join(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= limit)


#: Entries of a table of terms and queries that is sent to every task; low bits of a best line's code that hold its place.
TERM_TABLE, PLACE = 32 << 20, 40


def best_snippets(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, pos, hits): per query and document the chunk with the most distinct query terms, the first on a tie.

    A table of terms and queries goes out to every task and adds up each chunk's terms for all queries at
    once, so a row is made per query and document, not per query, chunk and term. With a table beyond
    ``TERM_TABLE`` terms meet in a join.
    """
    q = written(queries.select("qid", F.explode(F.array_distinct(T.search_terms(F.col("text")))).alias("term")), "wanted")
    n = q.agg(F.count_distinct("qid").alias("q"), F.count_distinct("term").alias("t")).first()
    if n.q * n.t > TERM_TABLE:
        c = _held_terms(chunks.select(F.struct("id", "pos").alias("id"), "text"), q).filter("term is not null").select("id.id", "id.pos", "term")
        hits = c.join(q, "term").groupBy("qid", "id", "pos").agg(F.count(F.lit(1)).alias("hits"))
        coded = hits.select("qid", "id", (F.shiftleft("hits", PLACE) + F.lit((1 << PLACE) - 1) - F.col("pos")).alias("code"))
    else:
        coded = _coded_lines(chunks, q.collect(), dict(queries.dtypes)["qid"])
    best = coded.repartition(parts_of(chunks), "id").groupBy("qid", "id").agg(F.max("code").alias("code"))  # all queries of a document in a task
    return best.select("qid", "id", (F.lit((1 << PLACE) - 1) - F.col("code").bitwiseAND(F.lit((1 << PLACE) - 1))).alias("pos"), F.shiftright("code", PLACE).alias("hits"))


def _coded_lines(chunks: DataFrame, wanted: list, kind: str) -> DataFrame:
    """(qid, id, code) of the best line in every run of a document's lines: its hits above, its place counted down below."""
    terms, qids = sorted({r.term for r in wanted}), sorted({r.qid for r in wanted})
    at, column = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(qids)}
    table = np.zeros((len(terms), len(qids)), np.uint16)
    for r in wanted:
        table[at[r.term], column[r.qid]] = 1
    shared = chunks.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), pa.array(qids), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, table = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                t = part.column(2)
                found = pa.compute.index_in(t.flatten(), value_set=names)
                line = pa.compute.list_parent_indices(t).to_numpy()[found.is_valid().to_numpy(zero_copy_only=False)]
                if not len(line):
                    continue
                first = np.flatnonzero(np.diff(line, prepend=-1))
                hits = np.add.reduceat(table[found.drop_null().to_numpy()], first, axis=0, dtype=np.uint16)
                line = line[first]
                code = (hits.astype(np.int64) << PLACE) + ((1 << PLACE) - 1 - part.column(1).to_numpy()[line])[:, None]
                code[hits == 0] = -1
                runs = part.column(0).take(pa.array(line)).dictionary_encode()
                begin = np.flatnonzero(np.diff(runs.indices.to_numpy(), prepend=-1))
                best = np.maximum.reduceat(code, begin, axis=0)
                r, c = np.nonzero(best >= 0)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(c)), part.column(0).take(pa.array(line[begin][r])), pa.array(best[r, c])], ["qid", "id", "code"])

    lines = chunks.select("id", F.col("pos").cast("bigint").alias("pos"), F.array_distinct(T.search_terms(F.col("text"))).alias("t"))
    return lines.filter("id is not null").mapInArrow(run, f"qid {kind}, id {dict(chunks.dtypes)['id']}, code bigint")
