"""Quality rules: text statistics and a decision list learned by sequential covering.

All of it is DataFrame expressions. Rules are conjunctions of thresholds on the statistics. They
are grown literal by literal for FOIL's information gain on two thirds of the labelled rows, cut
back to the prefix that does best on the other third, and kept while that third confirms them; the
rows a rule covers are then set aside. What a step needs are counts by statistic, threshold bin and
label, a few hundred numbers that Spark aggregates. The list is emitted as ordered ``when`` clauses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, words

#: Symbols whose characters are counted (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    """How often ASCII characters occur."""
    return (F.octet_length(text) - F.octet_length(_without(text, chars))).cast("long")


def _let(value: Column, use) -> Column:
    """``use`` of a value worked out once, however often ``use`` names it and wherever it is moved."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words of array ``w`` in windows that occur twice or more."""
    starts = F.when(F.size(w) > WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("key"), i.alias("at")))

    def covered(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["key"] == x["key"]) | (F.get(s, j + 1)["key"] == x["key"])
        places = F.array_sort(F.transform(F.filter(s, same), lambda x: x["at"]))
        # a window adds the words up to the next one's start, WINDOW at most
        fresh = lambda at: F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return _let(places, lambda at: F.aggregate(fresh(at), F.lit(0), lambda a, x: a + x))

    # all hashes distinct proves all windows distinct; only other texts compare the windows themselves
    again = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    return _let(hashes, lambda h: F.when(again(h), _let(F.array_sort(windows), covered)).otherwise(F.lit(0)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def statistics(text_col: str = "text") -> Column:
    """A struct of the STATISTICS (all long) of a whole text; null counts as empty, no words give zeros."""
    t = text_or_empty(text_col)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    values = lambda w: {
        "n_words": F.size(w),
        "word_chars": F.char_length(_without(t, " \t\n\x0b\x0c\r")),
        "n_symbols": _count(t, SYMBOLS),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(w),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "n_marks": _count(t, "!?"),
    }
    return _let(words(text_col), lambda w: F.struct(*[c.cast("long").alias(k) for k, c in values(w).items()]))


def base_failed(s: Column, min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > repeat_percent * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What the rules may test, from a struct of the STATISTICS."""
    rate = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return {
        "words": s["n_words"].cast("double"),
        "chars_per_word": rate("word_chars", "n_words"),
        "symbols_per_word": rate("n_symbols", "n_words"),
        "upper_per_char": rate("n_upper", "word_chars"),
        "marks_per_word": rate("n_marks", "n_words"),
        "dup_lines_per_word": rate("n_dup_lines", "n_words"),
        "repeats_per_word": rate("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    cut: float

    def test(self, s: Column) -> Column:
        x = features(s)[self.feature]
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Literal, ...]


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics of at most ``bound`` rows of labelled documents, as features, ``bad`` (label 0) and ``fold``.

    They are those of least hash of id and then of text, so that any run learns from the same ones
    and ids that repeat do not pass the bound; contradicting or null labels are left out, as are documents that
    fail the base rules. The ids chosen are bounded by ``bound`` and so broadcast: the documents are read once, not shuffled.
    """
    once = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most"))
    once = once.filter("_label = _most").drop("_most").withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(bound)
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(once), "_id")
    s = F.col("_s")
    found = found.select("_id", "_label", statistics("_text").alias("_s"), "_order", F.xxhash64("_text").alias("_tie"))
    rows = materialize(found.orderBy("_order", "_id", "_tie").limit(bound), "labelled-statistics").filter(~base_failed(s))
    return rows.select((F.col("_label") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).cast("int").alias("fold"), *[c.alias(k) for k, c in features(s).items()])


def learn_rules(rows: DataFrame, max_rules: int = 8, max_literals: int = 3, bins: int = 48, min_precision: float = 0.95, min_covered: int = 3) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows.

    A rule is kept if, on the rows it was not grown on, it covers ``min_covered`` bad ones and at
    least ``min_precision`` of what it covers is bad. No labelled rows, or only one label: no rule.
    """
    names = [c for c in rows.columns if c not in ("bad", "fold")]
    quantiles = rows.agg(*[F.percentile_approx(k, [j / bins for j in range(1, bins)], 10_000).alias(k) for k in names]).first()
    cuts = {k: sorted(set(quantiles[k] or [])) for k in names}
    # bin j of a feature: its values are over cuts[j - 1] and at most cuts[j]
    below = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts[k])), lambda c: c < F.col(k)))
    bin_of = {k: below(k) if cuts[k] else F.lit(0) for k in names}
    binned = materialize(rows.select("bad", "fold", *[bin_of[k].alias(k) for k in names]).groupBy("bad", "fold", *names).agg(F.count("*").alias("n")).coalesce(1), "statistics-counts")

    def inside(rule: list[tuple[str, bool, int]]) -> Column:
        test = F.lit(True)
        for k, above, j in rule:
            test = test & ((F.col(k) > j) if above else (F.col(k) <= j))
        return test

    def tally(df: DataFrame) -> dict[tuple[str, int], list[int]]:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("j")) for k in names])).alias("x")
        counted = df.select("bad", "n", each).groupBy("x.k", "x.j").agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum("n").alias("n"))
        return {(r.k, r.j): [r.p, r.n - r.p] for r in counted.collect()}

    found: list[list[tuple[str, bool, int]]] = []
    left = binned
    while len(found) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_literals:
            counts = tally(left.filter((F.col("fold") == 0) & inside(rule)))
            p0 = sum(v[0] for (k, _), v in counts.items() if k == names[0])
            n0 = sum(v[1] for (k, _), v in counts.items() if k == names[0])
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in names:
                p = n = 0
                for j in range(len(cuts[k])):
                    add = counts.get((k, j), [0, 0])
                    p, n = p + add[0], n + add[1]
                    for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if q:
                            gain = q * (math.log2(q / (q + m)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, (k, above, j)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.sum(F.when(inside(p), x)) for x in (F.col("n") * F.col("bad"), F.col("n")) for p in prefixes]
        got = [x or 0 for x in left.filter("fold = 1").agg(*sums).first()]
        value = [(2 * p - n) / n if n else -1.0 for p, n in zip(got[: len(rule)], got[len(rule) :])]
        k = max(range(len(rule)), key=lambda i: (value[i], -i))
        p, n = got[k], got[len(rule) + k]
        if p < min_covered or p < min_precision * n:
            break
        found.append(prefixes[k])
        left = left.filter(~inside(prefixes[k]))
    return [tuple(Literal(k, above, float(cuts[k][j])) for k, above, j in rule) for rule in found]


def verdict(rules: list[Rule], s: Column) -> Column:
    """Whether a document is kept: the first rule that holds rejects it, else it stays."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for literal in rule:
            test = test & literal.test(s)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(rules: list[Rule], text_col: str = "text") -> Column:
    """A struct of the STATISTICS, base_failed and kept of a text, in one narrow expression."""
    return _let(statistics(text_col), lambda s: F.struct(*[s[k].alias(k) for k in STATISTICS], base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept")))


def judge(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """doc_id, the STATISTICS, base_failed and kept of every document, a row for each row.

    The rules are learned from at most ``bound`` documents that ``labels`` has; they are applied
    to all documents where they are read, without a shuffle. Null and empty texts have no words and fail the base rules, rows that
    repeat each have a row, a null doc_id teaches nothing, without labels the base rules alone decide, and an empty table gives no rows.
    """
    rules = learn_rules(labelled_sample(docs, labels, bound))
    return docs.select("doc_id", judged(rules).alias("_s")).select("doc_id", "_s.*")


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """The documents that base rules and learned rules keep, with all their columns; see ``judge`` for nulls, repeated rows and empty tables."""
    rules = learn_rules(labelled_sample(docs, labels, bound))
    return docs.filter(judged(rules)["kept"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the STATISTICS that SQL can follow, and base_failed of every row; null and empty texts have zeros, an empty table no rows."""
    names = [k for k in STATISTICS if k not in ("n_upper", "n_marks")]
    rows = docs.select("doc_id", _let(statistics(), lambda s: F.struct(*[s[k].alias(k) for k in names], base_failed(s).alias("base_failed"))).alias("_s"))
    return rows.select("doc_id", "_s.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, k, words[k : k + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM s) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
