"""Text quality figures of each document, and whether it is prose, list, table or junk.

Figures are Spark expressions over the whole text. The verdict is an ordered rule list that incremental
reduced-error pruning induces from labelled documents; its thresholds go into one SQL CASE expression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the induction takes; it runs on the driver, on their few figures.
MAX_LABELLED = 10_000

#: Frequent function words of the languages that the texts are in.
COMMON_WORDS = tuple(
    """
    the a an of to and in is are was were be been for on that this it as by with or not at from has have had
    if which who what when how their its no may must shall should can will than then each any all once only
    el la los las de del que y en un una por con para se su al es lo como no si cada según sin cuando hasta
    le les des du et à dans un une pour par sur est que qui au aux son sa ce cette ne pas si selon avant lorsque
    der die das und ist nicht mit von den dem ein eine zu für auf im
    """.split()
)

_VOWEL = "aeiouyáéíóúüâêîôûàèùëïöäæœãõåø"
#: A token that reads as a word (in Latin script: with vowels, without capitals inside or long runs of
#: consonants; in other scripts: letters), as a number, date or amount, as a short code or as an address.
READABLE = (
    rf" (?:(?=[^ ]*[{_VOWEL}{_VOWEL.upper()}])(?![^ ]*[bcdfghjklmnpqrstvwxz]{{6}})(?:\p{{Lu}}?\p{{Ll}}+(?:[-'’­‐]\p{{L}}?\p{{Ll}}*)*|\p{{Lu}}+)"
    r"|[\p{L}&&[^\p{IsLatin}]][\p{L}\p{M}\p{N}&&[^\p{IsLatin}]]*"
    r"|[-+~]?[$€£]?[0-9][0-9,.:/-]*%?|[A-Z]{1,3}-?[0-9]{1,6}[A-Z]?|[A-Z]{2,4}|https?:[^ ]*|[A-Za-z][)])(?= )"
)
#: What parts words from each other besides white space, and what stands around them. Numbers of one or two
#: digits are left out: they tell nothing about whether a text can be read.
_SPACE = "\\t-\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
BETWEEN = rf"<[^<>]{{0,200}}>|\]\(|[|,;{_SPACE}]+| [^\p{{L}}\p{{N}}\p{{M}} ]{{1,3}}(?= )"
AROUND = r" [\p{Ps}\p{Pi}\"'*_#¿¡.:-]+|(?<! [A-Za-z])[\p{Pe}\p{Pf}\"'*_.:!?…#-]+(?= )"
SMALL_NUMBER = r" [0-9]{1,2}(?= )"

MARKED = r"^\s*([-*+•‣▪◦·–—]\s|\(?([0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]\s|[☐☑✓✔➢➤→]\s?)\s*\S"
LINKED = r"^\s*([-*+•]\s*)?(\[[^\]]*\]\([^)]*\)|https?://\S+)\s*$"
HEADING = r"^\s*(#{1,6}\s|(Section|Chapter|Sec\.|§)?\s*[0-9]+(\.[0-9]+)+\s+\S+(\s+\S+){0,4}$)"
CELLS = (
    r"<t[dhr][ >]|^\s*\|.*\|\s*$|\S\s*\|\s*\S.*\|\s*\S|\S\t+\S|\S {3,}\S.*\S {3,}\S|^\S+( \S+){0,5} {3,}\S+( \S+){0,5}$"
    r"|^[^,\s][^,]{0,50}(,[^,\s][^,]{0,50}){2,}$|^[^;]{1,60}(;[^;]{0,60}){2,}$|^[\s|+:=-]*-{3,}[\s|+:=-]*$"
)
#: A line without any of these is no row of cells.
CELL_MARKS = r"[|\t;]|<t| {3}|,\S|--"
ENDS = r"[.!?:;…。！？]['\"”’»)\]]*\s*$"

FEATURES = ("readable_share", "cell_share", "entry_share", "common_share", "closed_share", "symbol_ratio", "mean_word_length")
SHAPES = ("junk", "table", "list", "prose")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def figures(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """documents with word_count, mean_word_length, symbol_ratio, closed_share (lines that end in punctuation),
    common_share (words that are frequent function words), size_bytes and the shares the rules use.

    Null and blank texts have zeros everywhere. Any other columns are kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(?U)\S"))
    spaced = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), BETWEEN, " "), AROUND, " ")
    tokens = F.filter(F.split(F.regexp_replace("__spaced", SMALL_NUMBER, " "), " "), lambda x: x != "")
    words = F.filter("__tokens", lambda x: x.rlike(r"\p{L}"))
    entry = lambda x: (
        x.rlike(MARKED) | x.rlike(LINKED) | ((F.size(F.split(F.trim(x), r"\s+")) <= 6) & ~x.rlike(r"[.?!,;\-¬­‐]\s*$"))
    )
    prior = lambda c: F.concat(F.array(F.lit("")), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))
    solid = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
    repeats = F.size(F.filter(F.zip_with("__tokens", prior(F.col("__tokens")), lambda x, p: x == p), lambda x: x))
    base = documents.withColumns({"__lines": lines, "__spaced": spaced}).withColumn("__tokens", tokens).withColumns(
        {
            "__words": words,
            "__body": F.filter("__lines", lambda x: ~x.rlike(HEADING)),
            "__readable": F.greatest(F.regexp_count("__spaced", F.lit(READABLE)) - F.regexp_count("__spaced", F.lit(SMALL_NUMBER)) - repeats, F.lit(0)),
        }
    )
    body = F.size("__body")
    out = base.withColumns(
        {
            "word_count": F.size("__words"),
            "mean_word_length": _share(F.aggregate("__words", F.lit(0), lambda a, w: a + F.length(w)), F.size("__words")),
            "symbol_ratio": _share(F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{M}\p{N}\s]+", "")), solid),
            "closed_share": _share(F.size(F.filter("__lines", lambda x: x.rlike(ENDS))), F.size("__lines")),
            "common_share": _share(F.size(F.filter("__words", lambda w: F.lower(w).isin(*COMMON_WORDS))), F.size("__words")),
            "readable_share": F.when(F.size("__words") == 0, 0.0).otherwise(_share(F.col("__readable"), F.size("__tokens"))),
            "cell_share": _share(F.size(F.filter("__body", lambda x: x.rlike(CELL_MARKS) & x.rlike(CELLS))), body),
            "entry_share": _share(F.size(F.filter("__body", entry)), body),
            "size_bytes": F.octet_length(t).cast("bigint"),
        }
    )
    return out.drop("__lines", "__spaced", "__tokens", "__words", "__body", "__readable")


@dataclass
class Rule:
    shape: str
    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, row: dict) -> bool:
        return all(row[f] < v if op == "<" else row[f] >= v for f, op, v in self.tests)

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {v!r}" for f, op, v in self.tests) or "TRUE"


def _grow(rows: list[dict], shape: str) -> Rule:
    """Adds the test of most information gain until the rule covers no other shape; thresholds lie midway."""
    rule, covered = Rule(shape), rows
    while any(r["shape"] != shape for r in covered):
        best, p0 = None, sum(r["shape"] == shape for r in covered)
        for f in FEATURES:
            values = sorted({r[f] for r in covered})
            for low, high in zip(values, values[1:]):
                for op in ("<", ">="):
                    v = (low + high) / 2
                    kept = [r for r in covered if (r[f] < v) == (op == "<")]
                    p = sum(r["shape"] == shape for r in kept)
                    if p:
                        gain = p * (log2(p / len(kept)) - log2(p0 / len(covered)))
                        # of equal gains the widest gap between neighbouring values counts
                        rank = (round(gain, 9), (high - low) / ((values[-1] - values[0]) or 1))
                        if gain > 1e-9 and (best is None or rank > best[0]):
                            best = (rank, (f, op, v), kept)
        if best is None:
            break
        rule.tests.append(best[1])
        covered = best[2]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on rows it was not grown on."""
    def worth(r: Rule) -> float:
        hit = [x["shape"] == r.shape for x in rows if r.covers(x)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    cuts = [Rule(rule.shape, rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    return max(cuts, key=lambda r: (worth(r), -len(r.tests))) if cuts else rule


def induce(rows: list[dict], default: str = "prose", folds: int = 3) -> list[Rule]:
    """Rules in order, for the rarer shapes first; rows none of them covers are the default.

    Each rule is grown on two thirds of the rows left, pruned on the other third, and kept while it is right on
    more than half of all rows it covers.
    """
    count = {s: sum(r["shape"] == s for r in rows) for s in SHAPES}
    left, rules = list(rows), []
    for shape in sorted((s for s in SHAPES if s != default and count[s]), key=lambda s: (count[s], SHAPES.index(s))):
        while any(r["shape"] == shape for r in left):
            third = lambda r: zlib.crc32(f"{len(rules)}:{r['sample_id']}".encode()) % folds == 0
            grow, prune = [r for r in left if not third(r)], [r for r in left if third(r)]
            if not any(r["shape"] == shape for r in grow):
                grow, prune = left, left
            rule = _prune(_grow(grow, shape), prune if any(r["shape"] == shape for r in prune) else left)
            hit = [r for r in left if rule.covers(r)]
            if not rule.tests or 2 * sum(r["shape"] == shape for r in hit) <= len(hit):
                break
            rules.append(rule)
            left = [r for r in left if not rule.covers(r)]
    return rules


def case_sql(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as SQL; a text without any word is junk whatever was learned."""
    return "CASE WHEN word_count = 0 THEN 'junk' " + " ".join(f"WHEN {r.sql()} THEN '{r.shape}'" for r in rules) + f" ELSE '{default}' END"


def learn(samples: DataFrame) -> list[Rule]:
    """The rule list of labelled rows (sample_id, markdown, shape); at most MAX_LABELLED of them, by sample_id."""
    labelled = samples.where(F.col("shape").isin(*SHAPES)).orderBy("sample_id").limit(MAX_LABELLED)
    return induce([r.asDict() for r in figures(labelled).select("sample_id", "shape", *FEATURES).collect()])


def classify(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """documents with their figures and shape. No shuffle: the learned CASE runs where the rows are."""
    return figures(documents).withColumn("shape", F.expr(case_sql(learn(samples))))


def only(judged: DataFrame, *shapes: str) -> DataFrame:
    """The rows of these shapes.

    A filter is moved below what it filters on, and there each mention of shape would work out all figures anew.
    It stays above a column that must not be worked out twice, such as a row number.
    """
    kept = judged.withColumn("__row", F.monotonically_increasing_id()).where(F.col("shape").isin(*shapes) & (F.col("__row") >= 0))
    return kept.drop("__row")


def quality(parse_result: DataFrame, conversion_diagnostics: DataFrame, samples: DataFrame) -> DataFrame:
    """Figures, shape and true size of each result beside the size its latest conversion states.

    The latest is that of the largest (converted_at, diag_id); stated_bytes and size_stated_right are null where
    no conversion states a size.
    """
    latest = conversion_diagnostics.where("result_id is not null").groupBy("result_id").agg(F.max_by("raw_markdown_bytes", F.struct("converted_at", "diag_id")).alias("stated_bytes"))
    judged = classify(parse_result.select("result_id", "markdown"), samples).drop("markdown")
    return judged.join(latest, "result_id", "left").withColumn("size_stated_right", F.col("stated_bytes") == F.col("size_bytes"))
