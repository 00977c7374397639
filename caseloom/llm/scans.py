"""Text of scanned pages made continuous: running headers and page numbers out, cut words joined, misreads put right.

Lines that repeat once their digits are masked are page furniture. Words are grouped by a skeleton that all
confusable glyphs share; within a group the rare forms are misread ones of the frequent form, and between
frequent forms the neighbouring words decide. Paragraphs are put together by windows over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.shape import classify, only
from caseloom.session import materialize

#: A form this many times rarer than the frequent form of its skeleton is a misread one; forms in between are
#: judged by their neighbours. Words up to this number are sent to every task; more are joined by shuffle.
RARER, NEIGHBOURS, BROADCAST_WORDS = 50, 20, 300_000

#: Documents in which a masked line must repeat before a single occurrence elsewhere counts.
SUPPORT = 3

#: Glyphs taken for each other, each written as what it falls apart into.
GLYPHS = (
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("0", "o"), ("5", "s"), ("1", "l"), ("|", "l"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("@", "a"), ("†", "t"), ("y", "v"), ("b", "h"), ("w", "vv"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("h", "li"),
    ("c", "e"), ("i", "l"),
)

CUT = "-‐‑¬­"
SOFT = "¬­"
SECTION = r"^\s*(#{1,6}\s|(?i:(section|sec\.|chapter|§)\s*)?[0-9]+(\.[0-9]+)+(\([a-z]\))?\s+\p{L})"
LISTED = r"^\s*([-*+•]\s+\p{L}|\(?([0-9]{1,3}|[A-Za-z]|[ivx]{1,4})[.)]\s)"
AMOUNT = r"^\s*[$€£]\s*[0-9.,]+\s*$"
ROMAN = r"^(?=[ivxl])(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
ODD = r"\p{L}[0-9@†|ﬀﬁﬂ]|[0-9@†|ﬀﬁﬂ]\p{L}"
DIGITLIKE = "0123456789oOlI|sSbB"


def skeleton(word: Column) -> Column:
    out = F.lower(word)
    for glyph, parts in GLYPHS:
        out = F.replace(out, F.lit(glyph), F.lit(parts))
    return out


def roman_value(text: Column) -> Column:
    """The number of a small Roman numeral under one hundred."""
    units = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    tens = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
    table = F.create_map(*[F.lit(x) for n in range(1, 100) for x in (tens[n // 10] + units[n % 10], n)])
    return F.when(text.rlike(ROMAN), F.try_element_at(table, text))


def _digits(text: Column) -> Column:
    """Digits where letters stand for them."""
    return F.translate(text, "oOlI|sSbB", "001115588").try_cast("bigint")


def masked(line: Column) -> Column:
    """The line's skeleton with # for its numbers, misread ones included; without what follows a bar."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"\s+", " "), r"^([^|]*\p{L}{3}[^|]*?) \| \p{L}.*$", "$1 |")
    page = F.regexp_replace(bare, r"(?i)(?<=\bpage |\bp\. |\bof )[lIoO|]+$", "#")
    return skeleton(F.regexp_replace(page, rf"(?<![\p{{L}}])[{DIGITLIKE}]*[0-9][{DIGITLIKE}]*(?![\p{{L}}])", "#"))


def scan_lines(prose: DataFrame) -> DataFrame:
    """(doc, result_id, pages, line_no, line) of results (result_id, markdown, page_count); doc tells rows apart."""
    numbered = prose.withColumn("doc", F.monotonically_increasing_id())
    rows = numbered.select("doc", "result_id", F.col("page_count").alias("pages"), F.posexplode(F.split("markdown", "\n")).alias("at", "line"))
    return rows.select("doc", "result_id", "pages", (F.col("at") + 1).alias("line_no"), "line")


def furniture(lines: DataFrame) -> DataFrame:
    """(doc, line_no) of running headers, footers and page numbers.

    A page number of its own counts if its neighbour, one less before or one more after it, is in the document
    too. A header or footer is a short masked line that recurs on half of the pages, that says the title again,
    or that recurs so in at least SUPPORT other documents.
    """
    t = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    short = (
        lines.withColumn("t", t)
        .where((F.length("t").between(1, 80)) & ~F.col("t").rlike(SECTION) & ~F.col("t").rlike(LISTED) & ~F.col("t").rlike(AMOUNT) & ~F.col("t").rlike(r"[.,;:?!]$") & ~F.col("t").rlike(rf"[{CUT}]$(?<!\s-)"))
        .where(F.col("t").rlike(r"^[\p{Lu}0-9\[(#–—•|-]|^[ivxlIO|]+$|^[lIoO|sSbB0-9]+$") & (F.size(F.split("t", r"\s+")) <= 9))
    )
    # few lines are left, and several ways of looking at them follow
    short = materialize(short.select("doc", "pages", "line_no", "t"), "scan-short")
    value = F.regexp_extract("t", rf"^(?:[-–—]\s*|\[)?([{DIGITLIKE}]+|[ivxl]+)(?:\s*[-–—]|\])?$", 1)
    style = (
        F.when(F.col("t").rlike(rf"^[-–—]\s*[{DIGITLIKE}]+\s*[-–—]$"), "dashed")
        .when(F.col("t").rlike(rf"^\[[{DIGITLIKE}]+\]$"), "bracketed")
        .when(F.col("t").rlike(rf"^[{DIGITLIKE}]*[0-9][{DIGITLIKE}]*$"), "bare")
        .when(F.col("t").rlike(ROMAN), "roman")
    )
    numbers = short.withColumn("style", style).where("style is not null").withColumn("n", F.when(F.col("style") == "roman", roman_value(F.col("t"))).otherwise(_digits(value)))
    by_value = Window.partitionBy("doc", "style").orderBy("n", "line_no")
    step = lambda f, d: (f("n").over(by_value) == F.col("n") + d) & ((f("line_no").over(by_value) - F.col("line_no")) * d > 0)
    numbered = numbers.withColumn("near", F.coalesce(step(F.lag, -1), F.lit(False)) | F.coalesce(step(F.lead, 1), F.lit(False))).where("near or style = 'dashed'").select("doc", "line_no")

    words = short.where(F.col("t").rlike(r"\p{L}{3}")).withColumn("mask", masked(F.col("t")))
    titles = lines.where("line rlike '^# '").groupBy("doc").agg(F.min_by("line", "line_no").alias("title"))
    plain = lambda c: F.regexp_replace(c, r"[^a-z]+", "")
    titled = words.join(titles, "doc", "left").withColumn("is_title", F.coalesce(plain(F.col("mask")) == plain(skeleton(F.col("title"))), F.lit(False)))
    same = Window.partitionBy("doc", "mask")
    counted = titled.withColumn("times", F.count("*").over(same)).withColumn("recurs", (F.col("times") >= 2) & (F.col("times") * 2 >= F.coalesce("pages", F.lit(1)) - 1))
    supported = counted.where("recurs").select("mask", "doc").distinct().groupBy("mask").agg(F.count("*").alias("docs")).where(F.col("docs") >= SUPPORT).select("mask")
    repeated = counted.where("recurs or is_title").select("doc", "line_no").unionByName(counted.where("not recurs and not is_title").join(supported, "mask", "left_semi").select("doc", "line_no"))
    return numbered.unionByName(repeated).distinct()


def _core(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"(?U)^[^\p{L}\p{N}@†|$]+|[^\p{L}\p{N}@†|]+$", ""))


def text_lines(lines: DataFrame) -> DataFrame:
    """The lines that are text, each with its tokens, the next text line's first token, and whether it ends, or
    the one before it ends, in a letter and a hyphen."""
    text = lines.join(furniture(lines), ["doc", "line_no"], "left_anti").where(F.col("line").rlike(r"(?U)\S"))
    by_line = Window.partitionBy("doc").orderBy("line_no")
    tokens = F.filter(F.split("line", r"(?U)[\s]+"), lambda x: x != "")
    out = text.withColumn("tokens", tokens).withColumn("cut", F.element_at("tokens", -1).rlike(rf"\p{{L}}[{CUT}]$"))
    return out.withColumns(
        {"next_first": F.lead(F.element_at("tokens", 1)).over(by_line), "after_cut": F.coalesce(F.lag("cut").over(by_line), F.lit(False))}
    ).withColumn("cut", F.col("cut") & F.col("next_first").isNotNull())


def inner_words(text: DataFrame) -> DataFrame:
    """(doc, result_id, line_no, word, before, after) of all tokens but those that touch a cut."""
    cores = F.transform("tokens", _core)
    kept = F.slice(cores, F.when(F.col("after_cut"), 2).otherwise(1), F.greatest(F.size("tokens") - F.col("cut").cast("int") - F.col("after_cut").cast("int"), F.lit(0)))
    rows = text.select("doc", "result_id", "line_no", kept.alias("w")).select("doc", "result_id", "line_no", "w", F.posexplode("w").alias("i", "word"))
    return rows.where("word <> ''").select("doc", "result_id", "line_no", "word", F.get("w", F.col("i") - 1).alias("before"), F.get("w", F.col("i") + 1).alias("after"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, skeleton, frequent, n_frequent): each word, its count, and the most frequent word of its skeleton.

    frequent of the most frequent word itself is the second one, with its count. Pure numbers are left out.
    """
    counts = words.where(r"word rlike '\\p{L}|[@†|]'").groupBy("word").agg(F.count("*").alias("n")).withColumn("skeleton", skeleton(F.col("word")))
    ranked = Window.partitionBy("skeleton").orderBy(F.desc("n"), "word")
    top, second = F.first(F.struct("word", "n")).over(ranked), F.lead(F.struct("word", "n")).over(ranked)
    return counts.withColumns({"top": top, "second": second}).select(
        "word", "n", "skeleton", F.when(F.col("word") == F.col("top.word"), F.col("second.word")).otherwise(F.col("top.word")).alias("frequent"),
        F.coalesce(F.when(F.col("word") == F.col("top.word"), F.col("second.n")).otherwise(F.col("top.n")), F.lit(0)).alias("n_frequent"),
    )


def misread_number(token: Column) -> Column:
    """Whether a token is a number, amount or form code in which letters stand for digits."""
    core = F.regexp_replace(F.regexp_replace(token, r"^[(\"'“]+|[)\"'”.,;:!?]+$", ""), r"\([a-z]$", "")
    mixed = core.rlike(rf"^\$?[{DIGITLIKE},.]+$") & core.rlike("[oOlI|sSbB]")
    fits = F.translate(core, "oOlI|sSbB", "001115588").rlike(r"^\$?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$")
    enough = core.rlike(r"^\$") | core.rlike(r"[0-9].*[0-9]") | (core.rlike("[0-9]") & core.rlike("[oOlI|]"))
    code = core.rlike(rf"^[A-Z]{{2}}-(?=.*[0-9])(?=.*[oOlI|sSbB])[{DIGITLIKE}]{{3}}$")
    return (mixed & fits & enough & ~core.rlike(r"^[A-Z][0-9][A-Z]$")) | code


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else df


def suspects(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words misread wherever they stand, pairs of words that only their neighbours tell apart)."""
    odd = F.col("word").rlike(ODD) & ~F.col("word").rlike(r"@.*\.|^[a-z][0-9][a-z]$|^[a-z]{2}-[0-9]+$|^[0-9]+(st|nd|rd|th)$")
    rare = (F.col("n") * RARER <= F.col("n_frequent")) | (odd & (F.col("n") < F.col("n_frequent"))) | (odd & F.col("word").rlike(r"[@†|ﬀﬁﬂ]"))
    rare = rare & ~F.col("word").rlike(r"^\$?[0-9.,]+$")
    always = vocab.where(rare).select("word", F.when(F.col("n_frequent") > F.col("n"), F.col("frequent")).alias("right"))
    pairs = vocab.where(~rare & (F.col("n_frequent") > 0) & (F.col("n_frequent") * RARER > F.col("n"))).select("word", "frequent")
    return always, pairs


def by_neighbours(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, result_id, line_no, word, right): occurrences whose neighbours on both sides go with the other word."""
    here = words.join(_sent(pairs), "word")
    left = here.groupBy("before", "word").agg(F.count("*").alias("n"))
    right = here.groupBy("word", "after").agg(F.count("*").alias("n"))
    other = lambda c, side, name: c.select(side, F.col("word").alias("frequent"), F.col("n").alias(name))
    own = lambda c, side, name: c.select(side, "word", F.col("n").alias(name))
    seen = (
        here.join(own(left, "before", "lw"), ["before", "word"], "left").join(own(right, "after", "rw"), ["after", "word"], "left")
        .join(other(left, "before", "lo"), ["before", "frequent"], "left").join(other(right, "after", "ro"), ["after", "frequent"], "left")
    )
    goes = lambda o, w, side: F.col(side).isNull() | (F.coalesce(o, F.lit(0)) >= F.greatest(F.coalesce(w, F.lit(0)), F.lit(1)) * NEIGHBOURS)
    some = F.col("before").isNotNull() | F.col("after").isNotNull()
    return seen.where(some & goes(F.col("lo"), F.col("lw"), "before") & goes(F.col("ro"), F.col("rw"), "after")).select("doc", "result_id", "line_no", "word", F.col("frequent").alias("right"))


def cut_words(text: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, result_id, line_no, next_no, part, rest, joined, right) of the lines that end within a cut word.

    A hyphen belongs to the word where the corpus knows the hyphenated word better than the joined one, or where
    both parts are words and the joined one is none. right is the frequent form if the joined one is misread.
    """
    by_line = Window.partitionBy("doc").orderBy("line_no")
    ends = text.withColumn("next_no", F.lead("line_no").over(by_line)).where("cut")
    part = _core(F.element_at("tokens", -1))
    ends = ends.select("doc", "result_id", "line_no", "next_no", part.alias("part"), _core(F.col("next_first")).alias("rest"), F.element_at("tokens", -1).rlike(f"[{SOFT}]$").alias("soft")).where("rest <> ''")
    ends = ends.withColumns({"joined": F.concat("part", "rest"), "whole": F.concat_ws("-", "part", "rest")})
    asked = ends.select("doc", "line_no", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("word")) for k in ("joined", "whole", "part", "rest")])).alias("q")).select("doc", "line_no", "q.*")
    known = asked.join(vocab.select("word", "n"), "word").groupBy("doc", "line_no").agg(*[F.max(F.when(F.col("kind") == k, F.col("n"))).alias(f"n_{k}") for k in ("joined", "whole", "part", "rest")])
    best = vocab.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("top"), F.max("n").alias("n_top"))
    seen = ends.withColumn("skeleton", skeleton(F.col("joined"))).join(known, ["doc", "line_no"], "left").join(best, "skeleton", "left")
    n = lambda k: F.coalesce(f"n_{k}", F.lit(0))
    is_cut = (
        F.when((n("whole") > 0) & (n("whole") >= n("joined")), False)
        .when((n("joined") > 0) | (n("top") > 0) | F.col("soft"), True)
        .otherwise(~((n("part") >= 5) & (n("rest") >= 5)))
    )
    right = F.when((F.col("top") != F.col("joined")) & ((n("top") >= RARER * n("joined")) | F.col("joined").rlike(ODD)), F.col("top"))
    return seen.where(is_cut).select("doc", "result_id", "line_no", "next_no", "part", "rest", "joined", right.alias("right"))


def _parts(results: DataFrame, samples: DataFrame) -> tuple[DataFrame, ...]:
    prose = only(classify(results, samples), "prose").select("result_id", "markdown", "page_count")
    lines = materialize(scan_lines(prose), "scan-lines")
    text = materialize(text_lines(lines), "scan-text")
    words = inner_words(text)
    vocab = materialize(vocabulary(words), "scan-words")
    always, pairs = suspects(vocab)
    cuts = materialize(cut_words(text, vocab), "scan-cuts")
    wrong = words.join(_sent(always), "word").select("doc", "result_id", "line_no", "word", "right").unionByName(by_neighbours(words, pairs))
    return lines, text, cuts, wrong


def scan_noise(results: DataFrame, samples: DataFrame) -> DataFrame:
    """(result_id, line_no, kind) with kind page_furniture, hyphen_break or misread, for the results that are prose.

    Null and blank texts have no lines; rows that repeat a result give its lines once.
    """
    lines, text, cuts, wrong = _parts(results, samples)
    kept = text.select("doc", "line_no")
    out = lines.join(kept, ["doc", "line_no"], "left_anti").where(F.col("line").rlike(r"(?U)\S")).select("result_id", "line_no", F.lit("page_furniture").alias("kind"))
    numbers = text.where(F.exists("tokens", misread_number)).select("result_id", "line_no")
    # of a cut word, the half that departs from the right form holds the misread glyph
    halves = cuts.where("right is not null").select("result_id", F.when(F.col("right").startswith(F.col("part")), F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"))
    misread = wrong.select("result_id", "line_no").unionByName(numbers).unionByName(halves).withColumn("kind", F.lit("misread"))
    broken = cuts.select("result_id", "line_no", F.lit("hyphen_break").alias("kind"))
    return out.unionByName(broken).unionByName(misread).distinct()


def paragraphs(results: DataFrame, samples: DataFrame) -> DataFrame:
    """(result_id, paragraph, text) of the results that are prose, in reading order.

    Furniture is out, cut words are joined, misread words replaced where the right form is known. A blank line
    ends a paragraph unless the sentence goes on after it: the text before it is unfinished and the text after it
    begins in lower case. Headings and list items stand alone.
    """
    _, text, cuts, wrong = _parts(results, samples)
    single = wrong.where("right is not null").groupBy("doc", "line_no", "word").agg(F.min("right").alias("right"))
    fixes = single.groupBy("doc", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("fix"))
    ends = cuts.select("doc", "line_no", F.coalesce("right", "joined").alias("whole"), F.length("part").alias("part_length"))
    heads = cuts.select("doc", F.col("next_no").alias("line_no"), F.lit(True).alias("headless"))
    rows = text.join(fixes, ["doc", "line_no"], "left").join(ends, ["doc", "line_no"], "left").join(heads, ["doc", "line_no"], "left")

    def put_right(token: Column) -> Column:
        right = F.try_element_at("fix", _core(token))
        cased = F.when(F.substring(F.regexp_replace(token, r"^[^\p{L}]+", ""), 1, 1).rlike(r"\p{Lu}"), F.initcap(right)).otherwise(right)
        return F.when(right.isNotNull(), F.concat(F.regexp_extract(token, r"(?U)^[^\p{L}\p{N}@†|$]*", 0), cased, F.regexp_extract(token, r"(?U)[^\p{L}\p{N}@†|]*$", 0))).otherwise(token)

    fixed = F.when(F.col("fix").isNull(), F.col("tokens")).otherwise(F.transform("tokens", put_right))
    start = F.when(F.col("headless"), 2).otherwise(1)
    last = F.element_at("tokens", -1)
    end_word = F.concat(F.regexp_extract(last, r"^[^\p{L}\p{N}]*", 0), F.when(last.rlike(r"^[^\p{L}]*\p{Lu}"), F.initcap("whole")).otherwise(F.col("whole")), F.regexp_extract("next_first", r"[^\p{L}\p{N}]*$", 0))
    kept = F.slice(fixed, start, F.greatest(F.size("tokens") - F.when(F.col("headless"), 1).otherwise(0) - F.when(F.col("whole").isNotNull(), 1).otherwise(0), F.lit(0)))
    joined = F.when(F.col("whole").isNotNull(), F.concat(kept, F.array(end_word))).otherwise(kept)
    by_line = Window.partitionBy("doc").orderBy("line_no")
    alone = F.col("line").rlike(SECTION) | F.col("line").rlike(LISTED)
    begun = (
        F.lag("line_no").over(by_line).isNull()
        | alone
        | F.lag(alone).over(by_line)
        | ((F.lag("line_no").over(by_line) < F.col("line_no") - 1) & (F.lag("line").over(by_line).rlike(r"[.!?:;][\"'”)]*\s*$") | ~F.col("line").rlike(r"^\s*[\p{Ll}0-9$(]")))
    )
    marked = rows.withColumn("words", F.array_join(joined, " ")).withColumn("begun", begun.cast("int"))
    grouped = marked.withColumn("paragraph", F.sum("begun").over(by_line)).groupBy("doc", "result_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "words"))).alias("parts"))
    return grouped.select("result_id", "paragraph", F.array_join(F.filter(F.transform("parts", lambda x: x["words"]), lambda x: x != ""), " ").alias("text"))
