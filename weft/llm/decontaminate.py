"""Benchmark decontamination by latent semantic retrieval.

1. Words: lower case, letters and digits. The benchmark is the stated query set. It is taken in groups of at
   most ``GROUP`` passages, with one pass over all documents for their words' frequencies and one for the
   search; a benchmark of some two thousand items is one group. All else is the same for each group.
2. TF-IDF: document frequencies of the group's words are counted over all documents, whole texts.
3. Passages: an item of more than ``WINDOW`` words is folded in as overlapping passages of ``WINDOW`` words,
   at most ``STEP`` apart, the last one at its end, so a cosine never depends on an item's length. An item of
   more than ``PIECE`` words is taken as pieces of so many words, each an item of its own with the same id.
4. Randomised SVD of the TF-IDF passages, distributed by spaces: each matrix of ``SPACE`` passages is multiplied
   by a random one, the range is refined by power iterations, and the small matrix that is left is decomposed in
   a task of its own. A space keeps ``KEEP`` dimensions a passage, fewer than it has passages (or items).
5. Search: a document is seen as windows with half of them shared, of the least of ``WIDTHS`` that holds the
   space's passages. A window is folded into each space. What truncation leaves of a passage's length is known, so
   the latent product over that share estimates the cosine without bias; items with a passage whose estimate
   reaches ``COSINE`` are candidates. Windows whose words' largest parts don't add up to that are left out,
   which loses none.
6. Runs: items that share ``RUN`` words in a row with the document (all words, if the item has fewer) are
   candidates whatever the cosine. They are found by hashes of the places of words in the vocabulary.
7. Check: for a candidate, the longest common subsequence of the item's words and the words around the
   windows must hold ``SHARE`` of the item, and of its answer, its last sentence, ``ANSWER`` (or of the
   item ``SURE``). Or a run of ``RUN`` words must be equal. Or the words there, in any order, must hold ``SURE`` of
   the item by weight (idf), the subsequence ``LEAST`` of it, and ``ANSWER`` of the answer: parts in another order.

Items of fewer than ``FEWEST`` words (and at least one) are found as runs of whole words; items without words are
never found. Null and empty texts hold nothing; very long texts are searched whole, in windows. Repeated rows of
documents are judged each. Repeated items with different ids are each reported, equal rows of the benchmark once.
An item in pieces has a row for each piece that is held. Without documents or items there are no rows. Extra columns are ignored by
``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, without_ids

SPACE, GROUP = 512, 4096
KEEP, OVER, POWER = 0.4, 16, 2
LEAST_KEPT = 0.2  # of a passage's squared length; one of which less is left counts as if so much were
WINDOW, STEP, PIECE = 24, 18, 20_000
WIDTHS = (6, 12, WINDOW)
COSINE = 0.4
SHARE, ANSWER, SURE, LEAST, RUN = 0.7, 0.5, 0.85, 0.45, 13
FEWEST = 5

_PLAIN = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PLAIN).split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence; the last third, if there is one sentence only."""
    words = words_of(text)
    parts = [p for p in (words_of(s) for s in re.split(r"[.!?:\n]+", text)) if p]
    return parts[-1] if len(parts) > 1 else words[-max(1, len(words) // 3) :]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of the rows of its table."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for word in b:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def common_run(a: list, b: list) -> int:
    """Length of the longest run of words that both have."""
    places: dict = {}
    for i, word in enumerate(a):
        places.setdefault(word, []).append(i)
    best, before = 0, {}
    for word in b:
        now = {i: before.get(i - 1, 0) + 1 for i in places.get(word, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def latent_space(rows, n_terms: int, seed: int, keep: float = KEEP):
    """Right singular vectors [n_terms, rank] of sparse rows [(terms, weights)] by a randomised range finder, and the dense rows."""
    import numpy as np

    dense = np.zeros((len(rows), n_terms), dtype=np.float32)
    for i, (terms, weights) in enumerate(rows):
        dense[i, terms] = weights
    rank = min(max(1, round(keep * len(rows))), n_terms)
    found = dense @ np.random.default_rng(seed).standard_normal((n_terms, min(rank + OVER, len(rows), n_terms)), dtype=np.float32)
    for _ in range(POWER):
        found = dense @ (dense.T @ np.linalg.qr(found)[0])
    basis = np.linalg.qr(found)[0]
    _, _, right = np.linalg.svd(basis.T @ dense, full_matrices=False)
    return right[:rank].T.astype(np.float32), dense


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """The passages of an item: all of it, or overlapping pieces of WINDOW words."""
    if len(words) <= WINDOW:
        return [words]
    n = -(-(len(words) - WINDOW) // STEP)
    return [words[a : a + WINDOW] for a in ((len(words) - WINDOW) * k // n for k in range(n + 1))]


def run_hashes(ids, length: int):
    """Hashes of the runs of ``length`` ids at each place; they wrap, so equal runs have equal hashes."""
    import numpy as np

    n = len(ids) - length + 1
    own = ids.astype(np.uint64) + np.uint64(1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    return total


class Index:
    """A group of items, their vocabulary, their passages' latent spaces and their runs."""

    def __init__(self, items: list[tuple[int, str]], idf, vocabulary: dict[bytes, int], spaces: list):
        import numpy as np

        self.vocabulary, self.spaces = vocabulary, spaces
        self.items = [(item, words_of(text), answer_of(text)) for item, text in items]
        self.idf = np.append(idf, np.median(idf) if len(idf) else 1.0).astype(np.float32)
        self.energy = self.idf.astype(np.float64) ** 2
        runs: dict[int, dict[int, set[int]]] = {}
        for place, (_, words, _) in enumerate(self.items):
            ids = np.array([vocabulary[w] for w in words], dtype=np.int64)
            length = min(RUN, len(words))
            for value in run_hashes(ids, length).tolist():
                runs.setdefault(length, {}).setdefault(value, set()).add(place)
        self.runs = {length: (np.array(sorted(held), dtype=np.uint64), held) for length, held in runs.items()}

    def candidates(self, ids):
        """(item's place, first word, last word, cosine) by windows."""
        import numpy as np

        n = len(ids)
        every = np.concatenate([[0.0], np.cumsum(self.energy[ids])])
        cuts = {}
        for owners, remap, folded, passages, most, width in self.spaces:
            if width not in cuts:
                starts = np.arange(0, max(1, n - width // 2), width // 2)
                ends = np.minimum(starts + width, n)
                cuts[width] = starts, ends, np.sqrt(every[ends] - every[starts])
            starts, ends, norms = cuts[width]
            local = remap[ids]
            bound = np.concatenate([[0.0], np.cumsum(most[local])])
            picked = np.nonzero(bound[ends] - bound[starts] >= (COSINE - 1e-4) * norms)[0]
            if not len(picked):
                continue
            padded = np.concatenate([local, np.full(width, len(most) - 1, dtype=np.int32)])
            for at in range(0, len(picked), 1024):
                part = picked[at : at + 1024]
                places = padded[starts[part][:, None] + np.arange(width)]
                sums = np.zeros((len(part), folded.shape[1]), dtype=np.float32)
                for k in range(width):
                    sums += folded[places[:, k]]
                cosines = (sums @ passages.T) / norms[part][:, None].astype(np.float32)
                for row, column in zip(*np.nonzero(cosines >= COSINE)):
                    yield owners[column], int(starts[part[row]]), int(ends[part[row]]), float(cosines[row, column])

    def equal_runs(self, ids):
        """(item's place, first word, last word, 0) by runs."""
        import numpy as np

        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for length, (values, held) in self.runs.items():
            if len(ids) < length:
                continue
            whole = known[length:] - known[:-length] == length
            if not whole.any():
                continue
            hashes = run_hashes(ids, length)
            near = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
            for at in np.nonzero(whole & (values[near] == hashes))[0].tolist():
                for place in held[int(hashes[at])]:
                    yield place, at, at + length, 0.0

    def weight(self, own: list[bytes], piece: list[bytes]) -> float:
        """The share of an item's words by weight, repeats included, that a piece has in any order."""
        left = Counter(piece)
        total = met = 0.0
        for word in own:
            worth = float(self.idf[self.vocabulary[word]])
            total += worth
            if left[word] > 0:
                left[word] -= 1
                met += worth
        return met / max(total, 1e-9)

    def search(self, text: str):
        """(item_id, cosine, lcs, answer, run) of each item that the text holds."""
        words = words_of(text)
        if not words:
            return
        import numpy as np

        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        regions: dict[int, list] = {}
        for item, start, end, cosine in sorted([*self.candidates(ids), *self.equal_runs(ids)]):
            around = len(self.items[item][1])
            start, end = max(0, start - around), end + around
            known = regions.setdefault(item, [])
            # windows and runs come in order; those that touch are one region, unless it has grown long
            if known and start <= known[-1][1] and known[-1][1] - known[-1][0] < 8 * (around + WINDOW):
                known[-1][1], known[-1][2] = max(known[-1][1], end), max(known[-1][2], cosine)
            else:
                known.append([start, end, cosine])
        for place in sorted(regions):
            item, own, answer = self.items[place]
            best, longest = None, 0
            for start, end, cosine in regions[place]:
                for a in range(start, end, max(1, len(own))):
                    piece = words[a : min(end, a + 2 * len(own) + 4)]
                    common = common_subsequence(own, piece)
                    shared = common / len(own)
                    if shared < LEAST and common < RUN:  # a run is a common subsequence
                        continue
                    run = common_run(own, piece)
                    held = common_subsequence(answer, piece) / len(answer)
                    if (shared >= SHARE and held >= ANSWER) or shared >= SURE or run >= RUN or (shared >= LEAST and held >= ANSWER and self.weight(own, piece) >= SURE):
                        best, longest = max(best or (), (shared, held, cosine)), max(longest, run)
            if best:
                yield item, round(best[2], 4), round(best[0], 4), round(best[1], 4), longest


SCHEMA = "doc_id {id}, item_id {item}, cosine double, lcs double, answer double, run bigint"


def _frequencies(own: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(term, df) over all documents; each task adds up its own first."""

    def run(batches):
        import numpy as np

        counts = np.zeros(len(vocabulary), dtype=np.int64)
        get = vocabulary.get
        for batch in batches:
            for text in batch.column(0):
                held = {get(w, -1) for w in words_of(text.as_py())}
                held.discard(-1)
                counts[list(held)] += 1
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["term", "df"])

    return own.select("text").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _spaces(spark, texts: list[str], vocabulary: dict[bytes, int], idf) -> list:
    """[(items' places, terms' rows, folded terms [rows + 1, rank], passages [passages, rank], each term's largest part, window's width)] of each space, one task a space."""
    import numpy as np

    passages: dict[int, list[tuple[int, str]]] = {}
    for place, text in enumerate(texts):
        for words in passages_of(words_of(text)):
            passages.setdefault(next(w for w in WIDTHS if len(words) <= w), []).append((place, b" ".join(words).decode()))
    parts = [(width, own[b : b + SPACE]) for width, own in sorted(passages.items()) for b in range(0, len(own), SPACE)]
    frame = spark.createDataFrame([(k, [text for _, text in own]) for k, (_, own) in enumerate(parts)], "space bigint, texts array<string>").repartition(min(len(parts), 64))

    def run(batches):
        for batch in batches:
            out = []
            for space, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for text in texts:
                    terms, counts = np.unique([vocabulary[w] for w in text.encode().split()], return_counts=True)
                    terms = terms.astype(np.int64)
                    weights = np.sqrt(counts) * idf[terms]
                    rows.append((terms, weights / max(1e-9, np.linalg.norm(weights))))
                own = np.unique(np.concatenate([t for t, _ in rows]))
                places = {int(t): k for k, t in enumerate(own)}
                right, dense = latent_space([([places[int(t)] for t in terms], weights) for terms, weights in rows], len(own), space)
                out.append((space, own.astype(np.int32).tobytes(), right.tobytes(), (dense @ right).tobytes(), right.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), *[pa.binary()] * 3, pa.int64()))], names=["space", "own", "right", "latent", "rank"])

    # bounded: the spaces of one group, of at most GROUP passages of WINDOW words
    made = frame.mapInArrow(run, "space bigint, own binary, right binary, latent binary, rank bigint").collect()
    spaces = []
    for row in sorted(made, key=lambda r: r["space"]):
        own, rank = np.frombuffer(row["own"], np.int32), row["rank"]
        folded = np.vstack([np.frombuffer(row["right"], np.float32).reshape(-1, rank) * idf[own][:, None], np.zeros((1, rank))]).astype(np.float32)
        latent = np.frombuffer(row["latent"], np.float32).reshape(-1, rank)
        latent = latent / np.maximum((latent**2).sum(axis=1, keepdims=True), LEAST_KEPT)
        most = np.concatenate([np.maximum((folded[b : b + 4096] @ latent.T).max(axis=1), 0) for b in range(0, len(folded), 4096)])
        remap = np.full(len(vocabulary) + 1, len(own), dtype=np.int32)
        remap[own] = np.arange(len(own))
        width, held = parts[row["space"]]
        spaces.append(([place for place, _ in held], remap, folded, latent, most.astype(np.float64), width))
    return spaces


def _grouped(items: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's distinct rows (long ones in pieces) with their ``group``, of GROUP passages at most."""
    word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / PIECE)).cast("int")), lambda k: F.array_join(F.slice("words", k * PIECE + 1, F.lit(PIECE)), " "))
    words = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    # the text itself, with its sentences, unless it is long
    pieces = items.distinct().withColumn("words", words).select("item_id", F.explode(F.when(F.size("words") > PIECE, cuts).otherwise(F.array("text"))).alias("text"), F.size("words").alias("n"))
    sized = cut(pieces.withColumn("passages", 1 + F.floor(F.least("n", F.lit(PIECE)) / STEP)))
    n_groups = max(1, -(-(sized.agg(F.sum("passages")).first()[0] or 0) // GROUP))
    while True:
        grouped = sized.withColumn("group", F.pmod(F.xxhash64("text", "item_id"), F.lit(n_groups)))
        most = grouped.groupBy("group").agg(F.sum("passages").alias("n"), F.count("*").alias("rows")).agg(F.max(F.when(F.col("rows") > 1, F.col("n")))).first()[0] or 0
        if most <= GROUP:
            return cut(grouped), n_groups
        n_groups *= 2


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, run): a row for each document and item that it holds; run is the longest that they share there."""
    import numpy as np

    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    kinds = {"id": own.schema["doc_id"].dataType.simpleString(), "item": items.schema["item_id"].dataType.simpleString()}
    n_docs = max(1, own.count())
    grouped, n_groups = _grouped(items)
    results = []
    for group in range(n_groups):
        rows = grouped.filter(F.col("group") == group).orderBy("item_id", "text").collect()
        texts = [(r["item_id"], r["text"]) for r in rows]
        long = [(i, t) for i, t in texts if len(words_of(t)) >= FEWEST]
        short = [(i, b" " + b" ".join(words_of(t)) + b" ") for i, t in texts if 0 < len(words_of(t)) < FEWEST]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in long for w in words_of(t)}))}
        idf = np.full(len(vocabulary), np.log(n_docs + 1.0) + 1.0)
        if vocabulary:
            for row in _frequencies(own, vocabulary).collect():  # one row a word of the group
                idf[row["term"]] = np.log((n_docs + 1.0) / (row["df"] + 1.0)) + 0.1
        index = Index(long, idf, vocabulary, _spaces(spark, [t for _, t in long], vocabulary, idf) if long else [])
        shared = spark.sparkContext.broadcast(index.__dict__)

        def run(batches, shared=shared, short=short, kinds=kinds):
            held = Index.__new__(Index)
            held.__dict__.update(shared.value)
            for batch in batches:
                out = []
                for text, doc in zip(batch.column(0), batch.column(1).to_pylist()):
                    text = text.as_py()
                    if held.items:
                        out += [(doc, *found) for found in held.search(text)]
                    if short:
                        line = b" " + b" ".join(words_of(text)) + b" "
                        out += [(doc, item, 1.0, 1.0, 1.0, len(words.split())) for item, words in short if words in line]
                kind = batch.schema.field("doc_id").type
                named = pa.int64() if kinds["item"] == "bigint" else pa.int32() if kinds["item"] == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 6, (kind, named, *[pa.float64()] * 3, pa.int64()))], names=["doc_id", "item_id", "cosine", "lcs", "answer", "run"])

        results.append(own.mapInArrow(run, SCHEMA.format(**kinds)))
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; rows that share such a document's id go too."""
    gone = cut(contaminated(docs, benchmark, id_col, text_col).select("doc_id").distinct())
    return without_ids(docs, gone, id_col)


def benchmark_runs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents with RUN words of an item in a row, or all words of a shorter one."""
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+"), F.lit(0)))
    lengths = benchmark.groupBy("item_id").agg(F.max(n).alias("n"))
    return contaminated(docs, benchmark).join(lengths, "item_id").filter(F.col("run") >= F.least(F.lit(RUN), "n")).select("doc_id", "item_id").distinct()


RUNS_ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least({RUN}, len(w)) AS k FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, k, array_to_string(w[a:a + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM w, k)),
h AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS g FROM (SELECT item_id, w, least({RUN}, len(w)) AS k, unnest(range(1, len(w) - least({RUN}, len(w)) + 2)) AS a FROM i WHERE len(w) > 0))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (k, g)
"""
