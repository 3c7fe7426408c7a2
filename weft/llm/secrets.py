"""Secret scans by a trigram inverted index, with DataFrame functions alone.

* Each rule's regular expression is turned into a Boolean query over trigrams: a text can match
  only if it holds all trigrams of at least one clause. A rule without such trigrams (``hex``) is
  scanned in full.
* The index is partitioned by document: a text's postings, the trigrams of the queries that its
  lower-cased form holds, stay with the text. So the intersection of a clause's postings needs no
  shuffle, and ends at the first trigram that lacks the text. Texts are read once, and verified where they are.
* Candidates are verified by the rule's regular expression over the whole text.

``postings`` and ``candidates`` are the same index as a table, for texts that are searched by many sets of rules.

Kinds, in order: assign, access, hex, pem, github, jwt. A kind's spans are its pattern's leftmost
non-overlapping matches; a match that fails its length test is dropped, and the search goes on
behind it. Null and empty texts have no spans; very long ones take linear time. Each row is judged by
itself, so repeated rows, ties and null ids need no rule. An empty table gives an empty one.
``find_secrets`` returns two columns only, so other columns can't clash; ``without_secrets`` keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import let, spans_of, sql_spans


@dataclass(frozen=True)
class Rule:
    """``form`` decides what matches (and what trigrams a match must hold); ``scan`` finds the same in linear time, for matches of ``least`` characters."""

    kind: str
    form: str
    scan: str
    gate: str | None = None
    value: str | None = None  # what of the match is measured; else all of it
    least: int = 0  # characters of it


KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"(?:{KEYWORDS})[\"\\x27]?\\x20*[:=]\\x20*[\"\\x27]?[A-Za-z0-9+/_.=-]+"
RULES = (
    Rule("assign", ASSIGN, ASSIGN, value=f"^(?:{KEYWORDS})[\"\\x27]?\\x20*[:=]\\x20*[\"\\x27]?", least=12),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]++", least=18),
    Rule("hex", "[0-9a-f]+", "(?<![0-9a-f])[0-9a-f]{16,}+", gate="[0-9a-f]{16}", least=16),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+", "eyJ[A-Za-z0-9_-]++\\.eyJ[A-Za-z0-9_-]++"),
)
BASE_KINDS = ("assign", "access", "hex")

MOST = 64


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Clauses of lower-case trigrams; any match holds all of one clause's. An empty clause: no trigram is sure.

    Sub-expressions with few possible strings are multiplied out, so that trigrams may span them.
    """
    always = frozenset([frozenset()])

    def trigrams(words: set[str]) -> frozenset:
        return simplify(frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words))

    def simplify(clauses) -> frozenset:
        return always if frozenset() in clauses or len(clauses) > MOST else frozenset(c for c in clauses if not any(d < c for d in clauses))

    def both(p, q) -> frozenset:
        return simplify(frozenset(a | b for a in p for b in q)) if len(p) * len(q) <= MOST * 4 else max(p, q, key=lambda x: x != always)

    def letters(items) -> set[str] | None:
        got: set[str] = set()
        for op, arg in items:
            if str(op) == "LITERAL":
                got.add(chr(arg).lower())
            elif str(op) == "RANGE" and arg[1] - arg[0] < 4:
                got |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return got if len(got) <= 6 else None

    def walk(parsed):
        """(strings that it may be, or None; query)"""
        query, run, finite = always, {""}, True
        for op, arg in parsed:
            name, words, own = str(op), None, always
            if name == "LITERAL":
                words = {chr(arg).lower()}
            elif name == "IN":
                words = letters(arg)
            elif name == "SUBPATTERN":
                words, own = walk(arg[-1])
            elif name == "BRANCH":
                parts = [walk(branch) for branch in arg[1]]
                if all(w is not None for w, _ in parts):
                    words = set().union(*[w for w, _ in parts])
                else:
                    own = simplify(frozenset().union(*[trigrams(w) if w is not None else q for w, q in parts]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                inside, q = walk(inner)
                if inside is not None and high == 1:
                    words = inside | ({""} if low == 0 else set())
                elif low:
                    own = trigrams(inside) if inside is not None else q
            elif name == "AT":
                words = {""}
            if words is not None and len(run) * len(words) <= MOST:
                run = {a + b for a in run for b in words}
            else:
                finite = False
                query, run = both(both(query, trigrams(run)), trigrams(words) if words is not None else own), {""}
        return (run, always) if finite else (None, both(query, trigrams(run)))

    words, query = walk(_sre.parse(pattern))
    return trigrams(words) if words is not None else query


def clauses(rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, list[str]]]:
    """(rule's place, clause's place, trigrams); no row for a rule that is scanned in full."""
    return [(r, c, sorted(grams)) for r, rule in enumerate(rules) for c, grams in enumerate(sorted(trigram_query(rule.form), key=sorted)) if grams]


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index over (doc_id, text): (gram, doc_id) for the trigrams that the rules' queries name."""
    grams = sorted({g for _, _, own in clauses(rules) for g in own})
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))
    return docs.select("doc_id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules bigint): bit r is set if the text may match rule r."""
    rows = [(g, r, c, 1 << i, (1 << len(grams)) - 1) for r, c, grams in clauses(rules) for i, g in enumerate(grams)]
    assert len(rows) < 100_000, "the rules' trigrams are sent to all tasks"
    terms = index.sparkSession.createDataFrame(rows, "gram string, rule int, clause int, place bigint, whole bigint")
    met = index.join(F.broadcast(terms), "gram").groupBy("doc_id", "rule", "clause", "whole").agg(F.bit_or("place").alias("found"))
    return met.filter("found = whole").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def may_match(low: Column, rules: tuple[Rule, ...] = RULES) -> dict[int, Column]:
    """For each rule with trigrams, whether a lower-cased text's postings satisfy its query. A clause's longest trigrams in bytes and least usual letters come first."""
    usual = "etaoinsrhldcumfpgwybvkxjqz_"
    rare = lambda gram: -sum(usual.find(c) if c in usual else 40 for c in gram)
    queries: dict[int, Column] = {}
    for r, _, grams in clauses(rules):
        held = None
        for gram in sorted(grams, key=lambda g: (rare(g), g)):
            there = F.contains(low, F.lit(gram))
            held = there if held is None else held & there
        queries[r] = queries[r] | held if r in queries else held
    return queries


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start, place, end, kind, hit>> by start, then rule."""

    def of_rule(r: int, rule: Rule, may: Column | None) -> Column:
        gate = text.rlike(rule.gate or rule.scan)
        spans = spans_of(text, rule.scan, gate if may is None else may & gate)
        measured = (lambda h: F.regexp_replace(h, rule.value, "")) if rule.value else (lambda h: h)
        if rule.least:
            spans = F.filter(spans, lambda s: F.char_length(measured(s["hit"])) >= rule.least)
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("place"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), s["hit"].alias("hit")),
        )

    def found(low: Column) -> Column:
        may = may_match(low, rules)
        return F.concat(*[of_rule(r, rule, may.get(r)) for r, rule in enumerate(rules)])

    return F.array_sort(let(F.lower(text), found))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets), one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), let(text, lambda t: secret_spans(t, rules)).alias("secrets"))


def decisive(span: Column) -> Column:
    """Whether a span makes a document one with a secret: a hexadecimal run must have letters and digits, as card numbers and the like have not."""
    return (span["kind"] != "hex") | (span["hit"].rlike("[0-9]") & span["hit"].rlike("[a-f]"))


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose texts hold a decisive secret; the rest unchanged."""
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: secret_spans(t))
    return docs.filter(F.size(F.filter(found, decisive)) == 0)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, a hash of the base spans, and all spans."""
    found = find_secrets(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql() -> str:
    quoted = {r.kind: r.form for r in RULES} | {"hex": "[0-9a-f]{16,}"}
    lists = ", ".join(f"{sql_spans(p)} AS all_{k}" for k, p in quoted.items())
    tests = {"assign": f"length(regexp_replace(x.h, '{RULES[0].value}', '')) >= 12", "access": "length(x.h) >= 18", "hex": "length(x.h) >= 16"}
    kept = ", ".join(f"list_transform(list_filter(all_{r.kind}, lambda x: {tests.get(r.kind, 'true')}), lambda x: {{'s': x.s, 'p': {i}, 'e': x.e, 'k': '{r.kind}'}}) AS k_{r.kind}" for i, r in enumerate(RULES))
    text = lambda ks: "array_to_string(list_transform(list_sort(" + " || ".join(f"k_{k}" for k in ks) + "), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, {lists} FROM d),
q AS (SELECT doc_id, {kept} FROM p)
SELECT doc_id, {", ".join(f"len(k_{k})::BIGINT AS n_{k}" for k in BASE_KINDS)},
  sha256({text(BASE_KINDS)}) AS base_sha256, {text([r.kind for r in RULES])} AS spans
FROM q"""


ORACLE = _sql()
