"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's pattern a Boolean query over trigrams is derived: any match must hold all trigrams of one of its
clauses. The index posts each text under the trigrams that the queries ask for; postings are intersected clause by
clause, and only candidate texts are verified with the pattern. A rule without mandatory trigrams scans every text.
The index folds A-Z to lower case, so it may name too many candidates but never too few.

Null and empty texts hold no secrets. Repeated rows each get their spans, null ids are kept, and the caller's columns
travel inside one struct, so that no name can clash. Long texts need no special care: postings are per text and
trigram, and spans are counted in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_one, checkpointed, few_rows, flagged
from quarry.plans.spec import quoted


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters.

    Patterns use literals, classes, groups, alternation and repeats, the part that Java and RE2 read alike; letters of
    either case are written as classes.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


WORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])

#: The base rules, in the order of their kinds. Matches of the second and third fail if they are short whatever the
#: place they start at, so the least length stands in the pattern.
BASE = (
    Rule("assign", rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
#: Token formats that services publish, found besides the base.
MORE = (
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "xox[abpr]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 38),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE

#: More ways to spell a part than this count as a part that can be anything.
MOST_WAYS = 48
GAP = None


class _Reader:
    """Reads a pattern into its ways: sequences of literal strings and gaps."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def escape(self) -> str:
        c = self.take()
        if c == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        return "" if c.isalnum() else c

    def either(self) -> list[tuple]:
        ways = self.sequence()
        while self.peek() == "|":
            self.take()
            ways = ways + self.sequence()
        return ways if len(ways) <= MOST_WAYS else [(GAP,)]

    def sequence(self) -> list[tuple]:
        ways: list[tuple] = [()]
        while self.peek() not in ("", "|", ")"):
            more = self.repeat(self.atom())
            if len(ways) * len(more) > MOST_WAYS:
                more = [(GAP,)]
            ways = list(dict.fromkeys(a + b for a, b in product(ways, more)))
        return ways

    def atom(self) -> list[tuple]:
        c = self.take()
        if c == "(":
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            ways = self.either()
            self.take()
            return ways
        if c == "[":
            return self.members()
        if c == "\\":
            return [(e.lower(),)] if (e := self.escape()) else [(GAP,)]
        return [(GAP,)] if c == "." else [(c.lower(),)]

    def members(self) -> list[tuple]:
        found, open_ended = set(), self.peek() == "^"
        first = True
        while (c := self.take()) != "]" or first:
            first = False
            if c == "\\":
                c = self.escape()
                open_ended |= not c
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                found |= {chr(x).lower() for x in range(ord(c), ord(self.take()) + 1)}
            else:
                found.add(c.lower())
        return [(GAP,)] if open_ended or len(found) > 4 else [(x,) for x in sorted(found)]

    def repeat(self, ways: list[tuple]) -> list[tuple]:
        c = self.peek()
        if c == "?":
            self.take()
            return [*ways, ()]
        if c == "*":
            self.take()
            return [(GAP,)]
        if c == "+":
            self.take()
            return [(*w, GAP) for w in ways]
        if c == "{":
            end = self.p.index("}", self.i)
            least = int(self.p[self.i + 1 : end].split(",")[0] or 0)
            self.i = end + 1
            return [(*w, GAP) for w in ways] if least else [(GAP,)]
        return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which holds for every match; None if a match may have none."""
    clauses = set()
    for way in _Reader(pattern).either():
        runs = reduce(lambda a, x: [*a, ""] if x is GAP else [*a[:-1], a[-1] + x], way, [""])
        grams = frozenset(r[k : k + 3] for r in runs for k in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of a rule's matches in code points, from the lengths of matches and of what stands between them."""
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    kept = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    lengths = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("all"), kept.alias("part")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("all"), F.length(x["part"]).alias("part")))
    span = "struct<start:int,kind:int,end:int,part:int>"
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<{span}>").alias("got")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["all"], F.lit(0))).alias("at"),
            F.concat(
                F.coalesce(acc["got"], F.array().cast(f"array<{span}>")),
                F.when(x["part"] >= rule.least, F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("kind"), (acc["at"] + x["gap"] + x["all"]).alias("end"), x["part"].alias("part")))).otherwise(F.array().cast(f"array<{span}>")),
            ).alias("got"),
        ),
    )["got"]


def trigram_index(docs: DataFrame, key: Column, text: Column, grams: list[str]) -> DataFrame:
    """Postings (gram, key): the texts that hold each asked trigram; ``gram`` is its place in ``grams``."""
    low = docs.select(key.alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]], grams: list[str]) -> DataFrame:
    """(key, rules): a bit for each rule one of whose clauses has all its trigrams posted for the key."""
    place = {g: i for i, g in enumerate(grams)}
    rows = [(rule, n, place[g], len(clause)) for rule, clauses in queries.items() for n, clause in enumerate(clauses) for g in clause]
    asked = few_rows(index.sparkSession, rows, "rule int, clause int, gram int, need int")  # as long as the rules
    met = index.join(F.broadcast(asked), "gram").groupBy("key", "rule", "clause").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, gram)"))).alias("n"), F.max("need").alias("need"))
    return met.where("n = need").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct and its spans (start, kind, end, part) by start, then kind.

    Starts and ends are code points, ends exclusive; ``kind`` is the rule's place in ``rules``, ``part`` the length
    that the rule measures. At most 62 rules, and 62 trigrams asked for.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q}
    grams = sorted({g for q in indexed.values() for clause in q for g in clause})
    if max(len(rules), len(grams)) > 62:
        raise ValueError("too many rules or trigrams for one mask; split the rules")
    id_, text = quoted(id_col), quoted(text_col).cast("string")
    key = F.xxhash64(id_, text)  # rows that happen to share a key only share candidates, which are verified
    rows = docs.select(as_one(docs), text.alias("text"), key.alias("key"))
    if indexed:
        found = checkpointed(candidates(trigram_index(docs, key, text, grams), indexed, grams))
        # A bitmap of the candidates' keys leaves all other texts where they are.
        rows = flagged(rows, F.col("key"), found.select("key"))
        tried = rows.where("_maybe").join(found, "key", "left").select("row", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
        rows = rows.where("not _maybe").select("row", "text", F.lit(0).cast("long").alias("rules")).unionByName(tried)
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,part:int>>")
    parts = []
    for i, rule in enumerate(rules):
        asked = F.col("rules").bitwiseAND(F.lit(1 << i)) != 0 if i in indexed else F.col("text").isNotNull()
        # Most texts that are verified hold nothing: one search tells, before the places are worked out.
        parts.append(F.when(asked & F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule, i)).otherwise(none))
    return rows.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [_count_of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return find_secrets(docs, RULES, id_col, text_col).select(F.col("row").getField(id_col).alias(id_col), *counts, F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(F.col("spans"), RULES).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``find_secrets`` with each run of touching or overlapping spans replaced by ``mark``."""
    text = F.col("row").getField(text_col)
    out = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("got")),
        lambda acc, s: F.when(
            (s["start"] >= acc["at"]),
            F.struct(s["end"].alias("at"), F.concat(acc["got"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("got")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["got"].alias("got"))),
        lambda acc: F.concat(acc["got"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.select(F.col("row").withField(text_col, F.when(F.size("spans") > 0, out).otherwise(text)).alias("row"), "spans")


def oracle(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """DuckDB SQL for ``secret_report``: the same places, from plain scans of every text."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        select rid, {i} as kind, start, start + n_all as fin from (
          select rid, part, length(whole[i]) as n_all, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as start, length(part[i]) as n_part
          from (select rid, whole, part, gaps, unnest(range(1, len(whole) + 1)) as i from (
            select rid, regexp_extract_all(text, '{p}', 0) as whole, regexp_extract_all(text, '{p}', {r.group}) as part, regexp_split_to_array(text, '{p}') as gaps
            from docs where regexp_matches(text, '{p}')))) where n_part >= {r.least}""")
    kinds = "case kind " + " ".join(f"when {i} then '{r.kind}'" for i, r in enumerate(rules)) + " end"
    counts = ", ".join(f"count(*) filter (where kind = {i}) as n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""
    with docs as (select row_number() over () as rid, doc_id, text from documents),
    found as ({" union all ".join(parts)}),
    said as (select *, {kinds} || ':' || cast(start as bigint) || ':' || cast(fin as bigint) as s from found),
    grouped as (select rid, {counts}, string_agg(s, ',' order by start, kind) filter (where kind < {base}) as base, string_agg(s, ',' order by start, kind) as spans from said group by rid)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in rules[:base])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join grouped using (rid)"""
