"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Words are runs of characters that are not ASCII white space. On a bounded sample of `sample_rows` rows each rule's cost is measured (the time
of `repeats` evaluations a row in one job, less that of an empty job) and each row's set of failed rules is counted. The
order is then greedy: the rule that rejects most for its cost of the rows that the rules before it let pass. The base rules (too short, too repetitive)
are rules like the others. All stand in one CASE, each with its own features inside its branch, so a row costs only the features
of the rules up to the one that rejects it: keep() works so. judge() returns the base rules' features of every row; only the others' are short-circuited there.
The order changes the work and the rule named as the reason, never the verdict.

Nulls: a null text has no words and fails. A very long text is one row's work, linear but for a sort of its repeated windows' hashes, and
some 100 bytes a word. Ties (equal gain for the cost) go to the rule given first. Repeated rows are judged alike; an empty table gives no rows, with the
rules in their given order. Clashing names: keep() returns df's own columns whatever their names, judge() reads only id and text."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quivra.llm.common import quoted

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WIDTH = 5


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("long")


def _repeated_words() -> Column:
    """Words in windows of WIDTH words that occur twice. Without equal hashes nothing is repeated; equal hashes are compared as words."""
    words, n = F.col("words"), F.size("words")

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]))

    def covered(s: Column) -> Column:
        at = lambda k: F.slice(words, F.get(s, k)["i"] + 1, F.lit(WIDTH))
        same = lambda j, k: F.when(F.get(s, j)["x"] == F.get(s, k)["x"], at(j) == at(k))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        gain = lambda a: lambda total, j: total + F.least(F.lit(WIDTH), F.coalesce(F.get(a, j + 1) - F.get(a, j), F.lit(WIDTH)))
        total = lambda a: F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0), gain(a))).otherwise(F.lit(0))
        return _let(F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"])), total)

    def counted(g: Column) -> Column:
        sorted_ = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(sorted_, covered))

    found = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), counted))
    return F.when(n >= WIDTH, found).otherwise(F.lit(0)).cast("long")


#: Over the columns text, words and n_words of prepared().
FEATURES: dict[str, Callable[[], Column]] = {
    "word_chars": lambda: F.length(F.array_join("words", "")).cast("long"),
    "n_symbols": lambda: _count(f"[{SYMBOLS}]"),
    "n_lines": lambda: F.size(_lines()).cast("long"),
    "n_dup_lines": lambda: _let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": _repeated_words,
    "n_exclamations": lambda: _count("!"),
    "n_digits": lambda: _count("[0-9]"),
    "n_capitals": lambda: F.size(F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
}
#: What judge() returns.
RETURNED = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects(get): a condition; get(name) is a feature or n_words."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("short", lambda get: get("n_words") < 10),
    Rule("repeated words", lambda get: 100 * get("n_repeat_words") > 20 * get("n_words")),
)
#: Beyond the base rules; each leaves ordinary prose, lists of names and code comments alone.
RULES = (
    Rule("symbols", lambda get: get("n_symbols") > 0.1 * get("n_words")),
    Rule("repeated lines", lambda get: get("n_dup_lines") > 0.5 * get("n_lines")),
    Rule("exclamations", lambda get: get("n_exclamations") > 0.2 * get("n_words")),
    Rule("digits", lambda get: get("n_digits") > 0.3 * get("word_chars")),
    Rule("word length", lambda get: (get("word_chars") < 2 * get("n_words")) | (get("word_chars") > 20 * get("n_words"))),
    Rule("capitals", lambda get: get("n_capitals") > 0.5 * get("n_words")),
)


def inline(name: str) -> Column:
    """A feature as an expression of its own."""
    return FEATURES[name]() if name in FEATURES else F.col(name)


def prepared(df: DataFrame, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """keep, text, words and n_words."""
    base = df.select(*keep, F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), ""))
    return base.withColumn("n_words", F.size("words").cast("long"))


def measured(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 1000, repeats: int = 3, seed: int = 7) -> tuple[list[float], dict[int, int]]:
    """(seconds a row of each rule, how many sample rows fail each set of rules; bit k stands for rule k)."""
    total = df.count()
    if not total:
        return [0.0] * len(rules), {}
    sample = prepared(df.select(quoted(text_col).alias("text")).sample(min(1.0, sample_rows / total), seed)).persist()
    try:
        mask = sum((F.when(F.coalesce(r.rejects(inline), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
        sets = {r["mask"]: r["count"] for r in sample.groupBy(mask.alias("mask")).count().collect()}
        rows = sample.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def seconds(condition: Column) -> float:
            """The better of two runs."""
            took = []
            for _ in range(2):
                began = time.perf_counter()
                rows.agg(F.sum(condition.cast("long"))).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        empty = seconds(F.length("text") < 0)
        each = max(1, repeats * sum(sets.values()))
        return [max(seconds(r.rejects(inline)) - empty, 1e-4) / each for r in rules], sets
    finally:
        sample.unpersist()


def ordered(rules: tuple[Rule, ...], costs: list[float], sets: dict[int, int]) -> list[Rule]:
    """Greedy: most rejections for the cost among the rows that pass the rules before; rules that reject none stand last, the cheapest first."""
    rest, out = list(range(len(rules))), []
    while rest:
        hits = {k: sum(n for s, n in sets.items() if s >> k & 1) for k in rest}
        best = max(rest, key=lambda k: (hits[k] / (costs[k] + 1e-12), -costs[k] if not hits[k] else 0.0))
        rest.remove(best)
        out.append(rules[best])
        sets = {s: n for s, n in sets.items() if not s >> best & 1}
    return out


def cascade(rules: list[Rule], get: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, null for none."""
    chain = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        chain = chain.when(rule.rejects(get), F.lit(rule.name))
    return chain


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by)."""
    every = (*BASE, *rules)
    order = ordered(every, *measured(df, every, text_col, sample_rows))
    found = prepared(df, text_col, (quoted(id_col).alias("doc_id"),))
    found = found.select("doc_id", "text", "words", "n_words", *(inline(x).alias(x) for x in RETURNED))
    get = lambda name: F.col(name) if name in RETURNED else inline(name)
    base = BASE[0].rejects(get) | BASE[1].rejects(get)
    found = found.select("doc_id", "n_words", *RETURNED, base.alias("base_failed"), cascade(order, get).alias("rejected_by"))
    return found.select("doc_id", "n_words", *RETURNED, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, text_col: str = "text") -> DataFrame:
    """The rows of df that no rule rejects, columns unchanged."""
    every = (*BASE, *rules)
    order = ordered(every, *measured(df, every, text_col, sample_rows))
    row = F.struct(*[quoted(c) for c in df.columns]).alias("__row")
    judged = prepared(df, text_col, (row,)).select("__row", cascade(order, inline).alias("__rejected"))
    # a filter on the verdict would be pushed below the words and repeat them in each rule; what a generator makes is not
    passed = judged.select(F.explode_outer(F.when(F.col("__rejected").isNull(), F.array("__row"))).alias("__kept")).filter(F.col("__kept").isNotNull())
    return passed.select(*[F.col("__kept").getField(c).alias(c) for c in df.columns])
