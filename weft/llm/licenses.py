"""License scans by a generalised suffix automaton of licence words.

* Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
* Base: places where a phrase's words stand consecutively; each phrase has a label.
* Method: one suffix automaton holds the words of all templates (notices and texts). A file's words are
  streamed through it; the state at each word and the states of its suffixes give, for each template, the
  longest match that ends there. Matches of ``LEAST`` words or more that can't be extended are laid onto the
  templates, and chained where text and template go on in the same order with at most ``GAP`` words between. A
  chain that covers ``COVER`` of a template, and has each phrase that tells it from its kin unbroken, is a span.
* All spans of a template that don't overlap are kept, of overlapping ones the one that covers more (then the
  first). A span of which half or more lies in a span of another label that covers more goes.
* Score: the share of the template's words that the best span covers, times n / (n + 1) for its n words.
* Long texts: time is in proportion to a text's words times a constant of the templates. A chain is open while a
  match may join it, so open chains ended at most a template's length ago. Only runs of
  ``LEAST`` or more words that occur in some template are streamed; no match could lie outside of them.

Null and empty texts have no words, no labels and score 0. Each row stands alone, so repeated rows and
ties need no rule: labels are sorted. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.license_texts import TEMPLATES

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
LEAST = 3
GAP = 4
COVER = 0.75

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_SPACED).split()


class Automaton:
    """A suffix automaton of several word sequences. Each state knows where in the templates its strings end."""

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.long = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].add((number, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.long[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _new(self, long: int, link: int, moves: dict, ends: list) -> int:
        self.next.append(dict(moves))
        self.link.append(link)
        self.long.append(long)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes, ends: list) -> int:
        clone = self._new(self.long[p] + 1, self.link[q], self.next[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.long[q] == self.long[last] + 1 else self._split(last, q, word, ends)
        new = self._new(self.long[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.long[q] == self.long[p] + 1 else self._split(p, q, word, ends)
        return new

    def matches(self, words: list[bytes], first: int, end: int):
        """(template, last word's place in the text, in the template, length, low) of the matches in words[first:end] that can't be extended.

        They come by their last words; no later one starts before ``low``.
        """
        state = length = low = 0
        live: dict[tuple[int, int], int] = {}
        for at in range(first, end + 1):
            now: dict[tuple[int, int], int] = {}
            if at < end:
                word = words[at]
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.long[state]
                if word in self.next[state]:
                    state, length = self.next[state][word], length + 1
                else:
                    state = length = 0
                s, n = state, length
                while n >= LEAST:
                    for place in self.ends[s]:
                        now.setdefault(place, n)
                    s = self.link[s]
                    n = self.long[s]
            for (number, place), n in live.items():
                if (number, place + 1) not in now:
                    yield number, at - 1, place, n, low
            live, low = now, at - length + 1


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [(words_of(phrase), label) for phrase, label in base]
        self.labels = [label for label, _ in templates]
        self.templates = [words_of(text) for _, text in templates]
        self.telling = [[(len(words_of(text[: m.start()])), len(words_of(text[: m.end()])) - 1) for m in re.finditer(r"\{.*?\}", text)] for _, text in templates]
        self.automaton = Automaton(self.templates)
        self.known = {word: 1 for words in self.templates for word in words}
        self.heads: dict[bytes, list] = {}
        for words, label in self.base:
            self.heads.setdefault(words[-1], []).append((words, label))

    def spans(self, words: list[bytes], flags: bytes) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, covered words) of the chains that are finds, by first word."""
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        open_: dict[int, list[tuple[int, int, int, int, int]]] = {}  # per template: place in text, place in template, first word, covered, telling phrases
        at = flags.find(b"\x01" * LEAST)
        while at >= 0:
            end = flags.find(b"\x00", at)
            end = len(words) if end < 0 else end
            for number, last, place, length, low in self.automaton.matches(words, at, end):
                start, begin, telling = last - length + 1, place - length + 1, self.telling[number]
                has = sum(1 << k for k, (a, b) in enumerate(telling) if begin <= a and b <= place)
                chains = [c for c in open_.get(number, ()) if low - c[0] <= GAP + 1]  # the others can't be gone on with
                best = (length, has.bit_count(), -start, has)
                for c in chains:
                    if c[1] < place and c[0] < last and begin - c[1] <= GAP + 1 and abs((place - c[1]) - (last - c[0])) <= GAP:
                        both = c[4] | has
                        best = max(best, (c[3] + min(length, place - c[1], last - c[0]), both.bit_count(), -c[2], both))
                covered, n_told, first, told = best
                chains.append((last, place, -first, covered, told))
                open_[number] = chains
                if n_told == len(telling) and covered >= COVER * len(self.templates[number]):
                    held, span = found.setdefault(number, []), (number, -first, last, covered)
                    if not held or held[-1][2] < span[1]:
                        held.append(span)
                    elif covered > held[-1][3]:
                        held[-1] = span
            at = flags.find(b"\x01" * LEAST, end)
        kept: list[tuple[int, int, int, int]] = []
        for span in sorted((s for held in found.values() for s in held), key=lambda s: (-s[3], s[1], s[0])):
            label, half = self.labels[span[0]], (span[2] - span[1] + 1) / 2
            overlaps = [k for k in kept if min(k[2], span[2]) - max(k[1], span[1]) + 1 >= half]
            if all(self.labels[k[0]] == label and k[0] != span[0] for k in overlaps):
                kept.append(span)
        return sorted(kept, key=lambda s: (s[1], s[0]))

    def scan(self, text: str) -> dict:
        words = words_of(text)
        hits, labels = [], set()
        known = self.known
        flags = bytes([word in known for word in words])
        for head, phrases in self.heads.items():
            at = -1
            try:
                while True:
                    at = words.index(head, at + 1)
                    for phrase, label in phrases:
                        start = at - len(phrase) + 1
                        if start >= 0 and words[start : at + 1] == phrase:
                            hits.append(start)
                            labels.add(label)
            except ValueError:
                pass
        spans = self.spans(words, flags)
        kept = [(self.labels[n], a, b, covered / len(self.templates[n])) for n, a, b, covered in spans]
        return {
            "n_words": len(words),
            "n_base": len(hits),
            "first_word": min(hits) if hits else None,
            "last_word": max(hits) if hits else None,
            "base_labels": sorted(labels),
            "labels": sorted(labels | {s[0] for s in kept}),
            "score": max((covered / (len(self.templates[n]) + 1) for n, _, _, covered in spans), default=0.0),
            "spans": kept,
        }


SCHEMA = "doc_id {id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,cover:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Labels and spans of licences, one row per row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())])
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches):
        scanner = Scanner(base, templates)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            for row in found:
                row["spans"] = [dict(zip(("label", "first_word", "last_word", "cover"), s)) for s in row["spans"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([row[c] for row in found], t) for c, t in types.items())], names=["doc_id", *types])

    return own.mapInArrow(run, SCHEMA.format(id=kind))


def digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def phrases(docs: DataFrame) -> DataFrame:
    """The part of ``digest`` that plain phrases decide; places are -1 where there are none."""
    place = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return digest(docs).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


def _sql() -> str:
    longest = max(len(phrase.split()) for phrase, _ in BASE)
    here = lambda phrase: " AND ".join(f"w{k} = '{word}'" for k, word in enumerate(phrase.split()))
    hits = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM s WHERE {here(phrase)}" for phrase, label in BASE)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, i, w0, {", ".join(f"lead(w0, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, longest))} FROM e),
h AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM ({hits}) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, coalesce(a, -1)::BIGINT AS first_word, coalesce(b, -1)::BIGINT AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN h ON d.doc_id = h.doc_id"""


PHRASES_ORACLE = _sql()
