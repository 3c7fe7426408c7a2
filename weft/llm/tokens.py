"""Token counts by a digest cache.

Each text (null: empty) has a SHA-256 of its content; the tokenizer has one of its file and its library's
version. Counts are kept in a table under both. A run makes the texts distinct by digest, drops the
digests that the cache has, encodes the rest once each, appends their counts to the cache, and joins
all rows to it. Content is normalised only as far as no count can change: null becomes empty.

* Digests, lengths and ids alone are read first, and the distinct digests that the cache lacks are found among
  them: narrow rows. Only texts of misses are shuffled. If misses are few (by count) they are sent to all tasks,
  which drop other texts where they read them; with no miss no text is shuffled, nor read a second time.
* Misses are made distinct before they are encoded, and map tasks combine copies first, so a text that a
  third of all rows share is one row a map task in the shuffle.
* The last join has narrow rows (doc_id, digest, length); a hot digest's side is split by adaptive
  execution's skew join, and the other side has one row a digest.
* The cache is appended to by a committed write and read back, so a lost executor costs no lineage of
  encoding. Digests that two runs append at once are counted once.

Exact counts by words: in a BPE vocabulary in which no piece has a space mark behind another
character, and none has a line feed, no merge can cross the place before a space mark or either side
of a line feed. So a text's count is the sum over its words, which workers remember. Whether the
vocabulary is of that kind is tested on its pieces; if not, whole texts are encoded.

Rows that repeat, share an id or have none are each returned. Empty texts have 0 tokens. Very long texts are
encoded whole, word by word. An empty table gives an empty one, and adds nothing to the cache. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import BROADCAST_ROWS, cut

LIMIT = 4096
REMEMBERED = 400_000
CACHE_SCHEMA = "digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    made = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            made.update(block)
    return made.hexdigest()


class WordCounts(dict):
    """Tokens of a piece of text, computed when first asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def sentencepiece_counter(path: str):
    """A function from a text to its number of tokens, equal to encoding the whole text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)]
    probe = "  a①ﬁ b\t\n c  "
    plain = model.normalize(probe) == mark + probe.replace(" ", mark)
    splits = all(mark not in p.lstrip(mark) for p in pieces) and not any("\n" in p for p in pieces)
    # a merge table with other types of pieces might match them before merging
    whole = lambda text: len(model.encode(text, num_threads=1))
    if not (plain and splits and whole("\n") == 2 and whole("a b") == whole("a") + whole("b")):
        return whole
    words = WordCounts(whole)  # a word behind a space or at the start
    heads = WordCounts(lambda word: whole("\n" + word) - 2 if word else 0)  # behind a line feed
    run = re.compile(" +[^ ]+| +$")

    def spaced(line: str) -> int:
        """A line that begins with a space mark of its own, of any spacing."""
        total = 0
        for part in run.findall(" " + line):
            total += 1 if part == " " else whole(part[1:]) if part[-1] == " " else words[part[1:]]
        return total

    def one(line: str) -> int:
        """A line at the start of a text, not empty."""
        return spaced(line) if "  " in line or line[0] == " " or line[-1] == " " else sum(map(words.__getitem__, line.split(" ")))

    def later(line: str) -> int:
        """A line behind a line feed, without it."""
        if not line:
            return 0
        if line[0] == " ":
            return spaced(line[1:])
        head, space, rest = line.partition(" ")
        return heads[head] + (0 if not space else spaced(rest) if not rest or "  " in line or rest[-1] == " " or rest[0] == " " else sum(map(words.__getitem__, rest.split(" "))))

    def count(text: str) -> int:
        if not text:
            return 0
        if mark in text:
            text = text.replace(mark, " ")
        first, *rest = text.split("\n")
        # a text that begins with a line feed has the leading space mark alone before it
        return (one(first) if first else 1) + len(rest) + sum(map(later, rest))

    return count


def tokenizers_counter(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def counter(path: str):
    return sentencepiece_counter(path) if path.endswith(".model") else tokenizers_counter(path)


def _encoder(path: str):
    def run(batches):
        import os
        import sys

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = sys.__dict__.setdefault("_weft_counters", {})  # a worker's tasks share it
        count = kept.get(path) or kept.setdefault(path, counter(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_tokens), empty if there is no such table yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; the cache gets what it lacked."""
    spark = docs.sparkSession
    kept = f"{cache_path}/tokenizer={tokenizer_digest(model_path)[:32]}"
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest, F.octet_length(content).cast("long").alias("n_bytes")))
    misses = cut(rows.select("digest").distinct().join(read_cache(spark, kept).select("digest"), "digest", "left_anti"))
    n_misses = misses.limit(BROADCAST_ROWS + 1).count()
    if n_misses:
        texts, combined = docs.select(digest, content.alias("text")), lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
        # few misses: other texts are dropped at the scan; many: texts are combined, and the exchange serves the join as well
        fresh = combined(texts.join(F.broadcast(misses), "digest", "left_semi")) if n_misses <= BROADCAST_ROWS else combined(texts).join(misses, "digest", "left_semi")
        fresh.mapInArrow(_encoder(model_path), CACHE_SCHEMA).write.mode("append").parquet(kept)
    return rows.join(read_cache(spark, kept), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
