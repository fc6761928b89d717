"""Ranked lexical search: the best documents of every item of a query set.

Documents go through the Best Position Algorithm. Every term of the queries has a
list of documents by falling impact. A search reads the lists from the top; each
document it meets is looked up directly in the other lists, which tells its whole
score and its positions there. A list's best position is the last one up to which
every position is known, by whichever access. No unseen document can score above the
sum of the impacts at the best positions, so a search ends once that sum is strictly
below the k-th best score; at equality a tie might still be unseen.

Lists are built and searched per batch of documents inside the tasks, with the k best
so far carried from batch to batch. So a word that every document has makes no large
list anywhere, and what tasks find meets in at most k rows per task and item.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgate.llm.common import materialize

# What a term is; numbers of the weight, the length and the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH_PART, SATURATION, SCALE = 25, 12, 1_000_000_000

# Production parameters: documents returned per item, (item, term) pairs of one pass
# over the documents, positions a list is read on by in the first round, documents of a task.
BEST, PAIRS_AT_ONCE, FIRST_ROUND, DOCS_OF_A_TASK = 20, 200_000, 32, 10_000

# The same terms over UTF-8 bytes: separators become spaces, bytes of other letters stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, n``: the terms of every item with their number.

    Equal rows count once; different texts of one id are one query.
    """
    lowered = F.translate("text", UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    rows = items.select("item_id", "text").distinct()
    return rows.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(
        F.count("*").alias("n")
    )


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms' number, and those in the vocabulary by place."""
    place = {t.encode(): i for i, t in enumerate(vocabulary)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sizes, ends, terms, tfs, end = [], [0], [], [], 0
            for text in texts:
                words = terms_of(text or b"")
                sizes.append(len(words))
                ids = np.array([i for i in map(place.get, words) if i is not None], np.int32)
                own, counts = np.unique(ids, return_counts=True)
                end += len(own)
                ends.append(end)
                terms.append(own)
                tfs.append(counts.astype(np.int32))
            ends = pa.array(ends, pa.int32())
            flat = [np.concatenate(part) if part else np.zeros(0, np.int32) for part in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 *[pa.ListArray.from_arrays(ends, pa.array(f, pa.int32())) for f in flat]],
                ["doc_id", "n", "terms", "tfs"],
            )

    schema = f"doc_id {kind}, n long, terms array<int>, tfs array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class ImpactLists:
    """Impact lists of a batch of documents, and the documents' own rows for direct access.

    ``starts`` are the documents' places in ``terms`` and ``impacts``, which are in
    document order.
    """

    def __init__(self, starts, terms, impacts, n_terms):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        # Weights stay below 2^15 and quotients below 2^20, so an impact has 35 bits.
        order = np.argsort((terms.astype(np.int64) << 36) - impacts, kind="stable")
        self.list_starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.list_docs, self.list_impacts = of[order], impacts[order]
        self.positions = np.empty(len(order), np.int64)
        self.positions[order] = np.arange(len(order)) - self.list_starts[terms[order]]

    def search(self, query, k, known, slot, first=FIRST_ROUND):
        """Documents and scores that may be among the ``k`` best, given the ``known`` scores.

        ``query`` holds pairs of term and number. ``slot`` is a work array of -1 for every
        term, given back as it was.
        """
        lists = [(t, q) for t, q in query if self.list_starts[t] < self.list_starts[t + 1]]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return docs, scores
        at = np.array([t for t, _ in lists])
        numbers = np.array([q for _, q in lists], np.int64)
        starts = self.list_starts[at]
        sizes = self.list_starts[at + 1] - starts
        bases = np.concatenate([[0], np.cumsum(sizes)])
        slot[at] = np.arange(len(at))
        seen = np.zeros(bases[-1], bool)
        best_position = np.zeros(len(at), np.int64)
        met = np.zeros(len(self.starts) - 1, bool)
        best = np.sort(np.asarray(known, np.int64))[::-1][:k]
        depth, step = 0, first
        while True:
            # Sorted access: the next positions of every list.
            read = []
            for j in np.flatnonzero(sizes > depth):
                end = min(depth + step, sizes[j])
                read.append(self.list_docs[starts[j] + depth : starts[j] + end])
                seen[bases[j] + depth : bases[j] + end] = True
            new = np.unique(np.concatenate(read)) if read else np.zeros(0, np.int32)
            new = new[~met[new]]
            met[new] = True
            # Direct access: the new documents' places in all lists of the query.
            counts = self.starts[new + 1] - self.starts[new]
            ends = np.cumsum(counts)
            rows = np.arange(counts.sum()) + np.repeat(self.starts[new] - (ends - counts), counts)
            j = slot[self.terms[rows]]
            inside = j >= 0
            seen[bases[j[inside]] + self.positions[rows[inside]]] = True
            gained = np.where(inside, numbers[j] * self.impacts[rows], 0)
            total = np.concatenate([[0], np.cumsum(gained)])
            found = total[ends] - total[ends - counts]
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, found])
            best = np.sort(np.concatenate([best, found]))[::-1][:k]
            depth += step
            step *= 2
            bound = 0
            for j in range(len(at)):
                ahead = seen[bases[j] + best_position[j] : bases[j + 1]]
                stop = int(ahead.argmin()) if len(ahead) else 0
                best_position[j] += len(ahead) if len(ahead) and ahead[stop] else stop
                if best_position[j] < sizes[j]:
                    bound += int(numbers[j] * self.list_impacts[starts[j] + best_position[j] - 1])
            if (len(best) == k and bound < best[-1]) or depth >= sizes.max():
                break
        slot[at] = -1
        return docs, scores


def _search_block(rows, queries, weights, n_docs, n_terms, k):
    """``item, doc_id, score``: the best ``k`` documents of every task for each query."""
    item_ids = [item for item, _ in queries]

    def run(batches):
        slot = np.full(len(weights), -1, np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            terms = batch.column("terms")
            starts = terms.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            flat = terms.flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            n = batch.column("n").to_numpy()
            m = 100 - LENGTH_PART + (LENGTH_PART * n * n_docs) // n_terms
            m = np.repeat(m, np.diff(starts))
            impacts = weights[flat] * ((SCALE * tf) // (1000 * tf + SATURATION * m))
            lists = ImpactLists(starts, flat, impacts, len(weights))
            ids = batch.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, (_, query) in enumerate(queries):
                docs, scores = lists.search(query, k, best[i][0], slot)
                keep = scores > 0
                docs, scores = docs[keep], scores[keep]
                joined = [
                    np.concatenate(pair)
                    for pair in zip(best[i], (scores, missing[docs], ids[docs]))
                ]
                order = np.lexsort((joined[2], joined[1], -joined[0]))[:k]
                best[i] = tuple(part[order] for part in joined)
        for item, (scores, missing, ids) in zip(item_ids, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=missing),
                 pa.array(scores, pa.int64())],
                ["item_id", "doc_id", "score"],
            )

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST,
           pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, from rank 1.

    Ties go by rising ``doc_id``, rows without id last. Texts count whole, however long; a
    null or empty one has no term, is never found and does not count in the number of documents.
    Repeated rows are documents of their own, with ranks of their own. Equal items count
    once, different texts of one ``item_id`` are one query; an item without a term, or whose
    terms no document has, has no rows, like empty tables. Other columns are not read.

    Items are taken in blocks of about ``pairs_at_once`` (item, term) pairs; a block's terms are
    sent to every task, so their size does not depend on the number of items. Statistics
    cover all documents.
    """
    queries = materialize(query_terms(items), "queries")
    n_blocks = max(1, -(-queries.count() // pairs_at_once))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        pairs = queries.filter(block == b).collect()
        vocabulary = sorted({p["term"] for p in pairs})
        place = {t: i for i, t in enumerate(vocabulary)}
        by_item: dict = {}
        for p in pairs:
            by_item.setdefault(p["item_id"], []).append((place[p["term"]], p["n"]))
        rows = materialize(postings(docs, vocabulary), "postings")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).head()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array(
            [term_weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64
        )
        block_queries = [(item, sorted(query)) for item, query in by_item.items()]
        # Searching costs more than reading, so tasks are made by the number of documents.
        tasks = max(1, -(-(n_docs or 0) // DOCS_OF_A_TASK))
        useful = rows.filter(F.size("terms") > 0).repartition(tasks)
        found.append(_search_block(useful, block_queries, weights, n_docs, n_terms or 1, k))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # Groups of tasks first, so that no item has more rows in one place than k per group.
    every = every.withColumn("_group", F.expr("spark_partition_id() div 128"))
    first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    inner = Window.partitionBy("item_id", "_group").orderBy(*first)
    some = every.withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= k)
    whole = Window.partitionBy("item_id").orderBy(*first)
    ranked = some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
SQL = f"""
    WITH t AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
         s AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM t WHERE len(terms) > 0),
         q AS (SELECT item_id, term, count(*) AS c
               FROM (SELECT item_id, unnest({_TERMS}) AS term
                     FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
         p AS (SELECT row, doc_id, n, term, count(*) AS tf
               FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM t)
               WHERE term IN (SELECT term FROM q) GROUP BY ALL),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
               FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
         f AS (SELECT item_id, row, doc_id,
                      CAST(sum(c * w * (({SCALE} * tf) // (1000 * tf + {SATURATION}
                        * (75 + ({LENGTH_PART} * n * n_docs) // n_terms)))) AS BIGINT) AS score
               FROM p JOIN q USING (term) JOIN w USING (term), s
               GROUP BY item_id, row, doc_id)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id
            ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
          FROM f WHERE score > 0)
    WHERE rank <= {BEST}"""
