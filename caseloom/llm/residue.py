"""Texts that are no content: unfilled template slots, filler copy, error pages and notices that demand scripts.

The sentences and lines of all texts, however long, are put into a prefix tree of fixed depth: first by their number
of words and telling words, then by their first words, numbers masked. In a leaf, messages that agree with its most
usual words make one template, and what is left is parted once more, so that a leaf can hold several. Templates are
classified once, by a few seed patterns and by what is learned from those: words that mark templates of the seeds
against templates of long texts, for templates that stand mostly alone; and templates that come along with error
messages only. Verdicts go back to all messages and are summed up for each document. Slots left open inside ordinary
text are looked for separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize

#: First words on a leaf's path, and share of a message's words that must agree with the leaf's usual ones.
DEPTH, AGREE = 1, 0.6

#: Words of a document in which a message counts as standing alone, and documents' share from which a template does.
SHORT, ALONE = 60, 0.5

#: Mean weight from which a template that stands alone is an error message, and how many marking words it needs.
MARKED, MARKS = 1.0, 2

#: Verdicts sent to every task; more are joined by shuffle.
BROADCAST_MESSAGES = 300_000

#: Other words that an error message may stand beside and still be all there is.
STRAY_WORDS = 6

_QUOTED = r"(?s)```.*?(```|$)|`[^`\n]+`|\"[^\"\n]+\"|“[^”\n]+”|‘[^’\n]+’|(?<=[\s(])'[^'\n]+'(?=[\s.,;:)])|<\|[^|<>\n]+\|>"
_TAGS = "HTML|HEAD|TITLE|BODY|META|LINK|SCRIPT|STYLE|DIV|SPAN|TABLE|THEAD|TBODY|STRONG|FORM|INPUT|LABEL|NOSCRIPT|IFRAME|CENTER"

#: A text without any of these has no slot; most texts are done with here.
_MARKS = r"[{}«»<\[%@]|__|\$\$|#[A-Z]|XX|\((?i:enter|insert|fill|type|add)"

#: The spellings of a slot, and of what a program prints for an empty value.
SLOTS = r"(?=[{<$«\[(%#_@X])(?:" + "|".join(
    (
        r"\{\{[^{}\n]+\}\}",
        r"\{%[^%{}\n]+%\}",
        r"<%=?[^%<>\n]+%>",
        r"\$\{[^{}\n]+\}",
        r"\$\$[A-Za-z_]\w*\$\$",
        r"\{![\w.]+\}",
        r"\{MERGEFIELD\s[^{}\n]+\}",
        r"(?<![\w$\\])\{([a-z][a-z0-9]*(_[a-z0-9]+)*|[0-9]{1,2})\}",
        r"<<[^<>\n]+>>",
        r"«[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)*»",
        r"\[\[[\w .-]+\]\]",
        r"\[(TBD|TBC|TODO|INSERT|ENTER|FILL|YOUR|PLACEHOLDER)\b[^\]\n]*\](?!\()",
        r"(?i:\[(insert|enter|your|fill in)\s[^\]\n]+\])(?!\()",
        r"\[[A-Z][\w ]+ (here|HERE)\]",
        r"\[object Object\]",
        r"(?i:\((enter|insert|fill in|type your|add your)\s[^)\n]+\))",
        r"%[A-Z][A-Z0-9]*(_[A-Z0-9]+)*%",
        r"#[A-Z][A-Z0-9]{2,}(_[A-Z0-9]+)*#",
        r"__[A-Z][A-Z0-9]*(_[A-Z0-9]+)*__",
        r"@@\w+@@",
        rf"<(?!(?:{_TAGS})\b)[A-Z]{{4,}}( [A-Z]+)*>|<[A-Z]{{2,}}( [A-Z]+)+>",
        r"\bXX[/.-]XX[/.-]XX(XX)?\b",
        r"(?<![\w%])%[sd](?!\w)",
    )
) + ")"
_NOTHING = ("undefined", "null", "NULL", "NaN", "None", "nil")
#: What a program prints for nothing, where a value should stand: after a greeting or title, a label, or a word that asks for one.
EMPTY_VALUES = (
    r"(?m)(?:^\W*|[.!?]\s+)\p{Lu}\p{L}+(?:/\p{L}+)?(?: \p{L}+){0,3}(?<!\b(?:is|are|was|of|or|as|with|be)) (?:null|NULL|NaN|nil|undefined|None)(?=[,:!]|$)"
    r"|\b\p{Lu}[\p{L} ]{1,20}: ?(?:null|NULL|NaN|None|nil|undefined)(?=[\s,.;]|$)"
    r"|\b(?:amount is|at|from|for|about|on|until|by) (?:null|NULL|NaN|nil|undefined|None)(?=[,.;:!?)]|\s*$|\s(?:is|was|has|will|and|at|on|in)\b)"
    r"|(?<!\b[Aa]n )(?<!\bis )\bundefined\b(?! (?:term|behaviou?r|word|concept))|\bis undefined\b"
)

#: Syllables of the usual filler Latin.
_LATIN = r"(?i)^(lo|rem|lor|do|ip|sum|sit|a|met|at|con|sec|te|tur|e|lit|sed|tem|por|in|ci|di|ut|la|bo|re|et|mag|na|li|qua|que|vel|ren|cri|bra|gni|tus|pe|ti|se|sa|ma|or|um|ni|us|is|am|nis|tis|mus)+$"

#: Fixed values, the seeds of filler and of error messages, on messages in lower case.
FILLER = r"^(lorem ipsum\b.*|(this is |here is )?(an? |some |the )?(sample|placeholder|dummy|example|filler) (document|paragraph|copy|text|content|title|heading|sentence|page)s?\b.{0,30}|\W*(sub)?(title|text|heading|content|name|description|copy|body|image|caption) goes here\W*|\W*bullet point \w+\W*|(section|chapter|text|content|this (section|page|chapter|part)|to)?\W*(is )?(still )?(to )?be (written|completed|added|supplied|filled in|provided|determined|confirmed|announced)( later| soon)?\W*|(content|text|details|more) (to follow|to come|coming soon|follows?)\W*|(please )?(add|enter|insert|write|put|type|replace) (your|the|this|a) \w+( \w+)? (here|text)\W*|(replace|remove|delete|update) (this )?(text )?before (publishing|publication|release|going live)\W*|(todo|tbd|tbc|fixme|xxx+|n/a)\b.{0,40}|\W*(this )?page (is )?(intentionally|deliberately) (left )?blank\W*|coming soon\W*|(item|line|paragraph|row|entry|section|page) \S+ of (sample|placeholder|dummy) (copy|text|content)\b.*|\w+ copy,? not final\W*|(texte?|texto|contenu|contenido) (provisoire|provisional|de (ejemplo|relleno|muestra|remplissage)|d'exemple|fictif)\W*|pendiente de (redacci[oó]n|redactar|completar)\W*|([aà] (r[eé]diger|compl[eé]ter|venir)|contenu [aà] venir|por (redactar|completar|definir))\W*|(beispieltext|platzhaltertext|blindtext|platzhalter)\b.{0,20}|not final copy\W*|draft text\W*)$"
ERROR = "|".join(
    (
        r"java ?-?script|<noscript|\bscript(s|ing)\b.{0,60}\b(allow|enabl|turn|disabl|switch)|\b(allow|enabl|turn on|activ)\w*\b.{0,40}\bscript|\bscripts must be",
        r"^\W*(<num> )?(not found|forbidden|unauthorized|bad (gateway|request)|gateway time-?out|service unavailable|internal server error|too many requests)\b(?! [a-z])",
        r"^\W*(error|fatal|exception|traceback)\b|\"error\"|\w+(error|exception): ",
        r"\b(down|under|in|scheduled) (for )?maintenance|\bmaintenance (in progress|mode|window)|en (mantenimiento|maintenance)\b",
        r"^(?!\W*(if|when|where|once|unless)\b).*\b(page|file|document|link|site|address|content)\b.{0,60}\b((could ?n[o']t|cannot|can't|could not|can not) be (found|displayed|reached|opened|shown|served|converted)|(was|is|has) (gone|not (be )?(found|available))|no longer available|gone missing|has expired)",
        r"\b(something|that) (went|has gone) wrong|unexpected error|(can't|cannot|could not) find (what|the page) you|try again (later|in)|temporarily (unavailable|down)|connection (reset|refused|timed out)|(download|upload|conversion|export|import|request) failed|checking your browser",
        r"^\W*(please )?(sign|log) ?in\b|\b(must|need to|have to|please) (sign|log) ?in\b|login required|session (has )?(expired|timed out)|^\W*access (is )?denied\W*$|^\W*loading\b",
        r"p[aá]gina no (encontrada|disponible)|acceso denegado|sesi[oó]n ha caducado|page introuvable|acc[eè]s refus[eé]|session a expir[eé]|seite nicht gefunden",
    )
)
#: Messages that differ in one of these words never share a template.
TELLING = r"\b(not|no|error|failed|found|denied|expired|scripts?|placeholder|sample|text|here|written|later|null|undefined)\b"


def has_slot(text: Column) -> Column:
    """Whether a slot is left open outside of code, quotation and special tokens."""
    bare = F.regexp_replace(text, _QUOTED, " ~ ")
    nothing = F.lit(False)
    for word in _NOTHING:
        nothing = nothing | text.contains(word)
    return F.when(text.rlike(_MARKS), bare.rlike(SLOTS)).otherwise(False) | F.when(nothing, bare.rlike(EMPTY_VALUES)).otherwise(False)


def messages(documents: DataFrame) -> DataFrame:
    """(row, key, masked, words) of the sentences and lines of each text; markup parts them too. key stands for masked in shuffles."""
    uncoded = F.when(F.col("text").contains("```"), F.regexp_replace("text", r"(?s)```.*?(```|$)", "\n")).otherwise(F.col("text"))
    plain = F.regexp_replace(uncoded, r"(?i)</?(html|head|title|body|h[1-6]|hr|p|div|br|noscript|span|a|ul|li|center)\b[^<>]{0,100}>", "\n")
    plain = F.when(F.col("text").contains("<"), plain).otherwise(uncoded)
    said = F.explode(F.filter(F.split(plain, r"(?U)\n+|\r+|(?<=[.!?。！？])\s+"), lambda x: x.rlike(r"(?U)\w")))
    rows = documents.select("row", said.alias("message")).withColumn("message", F.trim(F.regexp_replace("message", r"(?U)\s+", " ")))
    masked = F.regexp_replace(F.regexp_replace(F.lower("message"), r"/[\w/.-]+", "/path"), r"\b[0-9a-f]*[0-9][0-9a-f]*\b", "<num>")
    return rows.select("row", masked.alias("masked")).select("row", _key("masked").alias("key"), "masked", F.size(F.split("masked", " ")).alias("words"))


def _key(text: str) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _grown(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((masked, template) of the messages that agree with their leaf's usual words, the others)."""
    cells = placed.select("leaf", "masked", F.posexplode("parts").alias("at", "part"))
    usual = cells.groupBy("leaf", "at", "part").agg(F.count("*").alias("n"))
    usual = usual.groupBy("leaf", "at").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    usual = usual.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda c: c["part"]).alias("usual"))
    agree = F.zip_with("parts", "usual", lambda a, b: a == b)
    judged = placed.join(usual, "leaf").withColumn("same", agree)
    judged = materialize(judged.withColumn("fits", F.size(F.filter("same", lambda x: x)) >= F.size("parts") * AGREE), "grown")
    # a position is kept where all that fit agree
    kept = judged.where("fits").select("leaf", F.posexplode("same").alias("at", "same")).groupBy("leaf", "at").agg(F.bool_and("same").alias("kept"))
    kept = kept.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kept"))), lambda c: c["kept"]).alias("kept"))
    made = judged.where("fits").join(kept, "leaf").select("masked", F.array_join(F.zip_with("usual", "kept", lambda u, k: F.when(k, u).otherwise("<*>")), " ").alias("template"))
    return made, judged.where("not fits").select("masked", "parts", "leaf")


def templates(said: DataFrame) -> DataFrame:
    """(masked, template): the template that each distinct message belongs to; its own where none fits."""
    distinct = said.select("masked").distinct().withColumn("parts", F.split("masked", " "))
    telling = F.array_join(F.regexp_extract_all("masked", F.lit(TELLING), F.lit(1)), " ")
    leaf = F.xxhash64(F.size("parts"), F.slice("parts", 1, DEPTH), telling)
    first, rest = _grown(materialize(distinct.select("masked", "parts", leaf.alias("leaf")), "messages"))
    second, left = _grown(rest.select("masked", "parts", F.xxhash64("leaf", F.element_at("parts", -1), F.slice("parts", DEPTH + 1, 1)).alias("leaf")))
    return first.unionByName(second).unionByName(left.select("masked", F.col("masked").alias("template")))


def _words(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"[\p{L}']+"), F.lit(0)))


def seeded(template: Column) -> Column:
    """filler, error or null: what the seeds say of a template, filler Latin and one word over and over included."""
    words = F.filter(F.split(F.regexp_replace(template, r"[.,;:?!]", ""), " "), lambda w: w != "")
    latin = template.rlike(r"^[a-z ,.;:?!-]{30,}$") & ~template.rlike(r"\b(the|of|and|is|for|with)\b")
    latin = F.when(latin, F.size(F.filter(words, lambda w: w.rlike(_LATIN))) >= 0.7 * F.size(words)).otherwise(False)
    return F.when(template.rlike(FILLER) | latin, "filler").when(template.rlike(ERROR), "error")


def word_weights(known: DataFrame) -> DataFrame:
    """(word, weight): how much more often a word is in templates that the seeds call errors than in those of long texts.

    known: template, kind and alone. Weights are logarithms of smoothed shares, from -4 to 4; words that no seed has
    are left out.
    """
    marked, plain = (F.col("kind") == "error") & F.col("alone"), ~F.col("alone")
    counts = known.select(F.explode(_words(F.col("template"))).alias("word"), marked.alias("m"), plain.alias("p"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    sizes = known.select(F.coalesce(marked, F.lit(False)).alias("m"), plain.alias("p")).agg(n("m").alias("all_m"), n("p").alias("all_p"))
    by_word = counts.groupBy("word").agg(n("m").alias("m"), n("p").alias("p")).where("m > 0").crossJoin(F.broadcast(sizes))
    weight = F.log((F.col("m") + 0.3) / (F.col("all_m") + 1)) - F.log((F.col("p") + 0.3) / (F.col("all_p") + 1))
    return by_word.select("word", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), weight)).alias("weight"))


def verdicts(said: DataFrame) -> DataFrame:
    """(key, kind) of the messages whose template is filler, error, or frame (what comes along with error messages).

    said: row, key, masked, words of all messages. A template that stands mostly alone, and that no seed names, is an
    error message by its words' mean weight; a template is frame if four of five of its documents are short and have
    an error message, and there are at least two of them.
    """
    mined = materialize(templates(said).select(_key("masked").alias("key"), _key("template").alias("t"), "template"), "templates")
    lengths = said.groupBy("row").agg(F.sum("words").alias("length"))
    uses = said.select("row", "key").distinct().join(mined.select("key", "t"), "key").select("row", "t").distinct()
    held = materialize(uses.join(lengths.select("row", (F.col("length") <= SHORT).alias("short")), "row"), "held")
    known = held.groupBy("t").agg((F.avg(F.col("short").cast("int")) >= ALONE).alias("alone"))
    # a generator, so that no template is looked at twice
    known = known.join(mined.select("t", "template").dropDuplicates(["t"]), "t")
    known = materialize(known.select("t", "template", "alone", F.explode(F.array(seeded(F.col("template")))).alias("kind")), "known")
    weights = materialize(word_weights(known), "weights")
    asked = known.where("alone and kind is null").select("t", F.size(_words(F.col("template"))).alias("words"), F.explode(_words(F.col("template"))).alias("word"))
    scored = asked.join(weights, "word").groupBy("t").agg((F.sum("weight") / F.max("words")).alias("mean"), F.sum((F.col("weight") >= MARKED).cast("int")).alias("marks"))
    learned = scored.where((F.col("mean") >= MARKED) & (F.col("marks") >= MARKS)).select("t", F.lit("error").alias("kind"))
    named = materialize(known.where("kind is not null").select("t", "kind").unionByName(learned), "named")
    bad = held.join(named.where("kind = 'error'"), "t", "left_semi").select("row").distinct().withColumn("bad", F.lit(1))
    along = held.join(named, "t", "left_anti").join(bad, "row", "left").groupBy("t").agg(F.count("*").alias("docs"), F.sum((F.col("bad").isNotNull() & F.col("short")).cast("int")).alias("bad"))
    frame = along.where("docs >= 2 and bad * 5 >= docs * 4").select("t", F.lit("frame").alias("kind"))
    return mined.select("key", "t").join(named.unionByName(frame), "t").select("key", "kind")


def _repeats(text: Column) -> Column:
    """Whether the text is one or two words over and over."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")
    over = (F.size(words) >= 5) & (F.size(F.array_distinct(words)) <= 2)
    return F.coalesce(F.when(text.rlike(r"(?iU)^\W*(\w+)\W+(?:\w+\W+)?\1\b"), over), F.lit(False))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, open_slot, filler, error_page) of the documents that hold residue; at least one of the three is true.

    error_page: a message of that kind and at most STRAY_WORDS words besides messages and page frame. filler counts
    in any part of a text. Null, empty and blank texts hold none. Rows that repeat a document come out once.
    """
    rows = documents.select("doc_id", "text").where(r"text rlike '(?U)\\S'").withColumn("row", F.xxhash64("doc_id", "text"))
    said = materialize(messages(rows), "said")
    found = materialize(verdicts(said), "verdicts")
    few = found.limit(BROADCAST_MESSAGES + 1).count() <= BROADCAST_MESSAGES
    judged = said.select("row", "key", "words").join(F.broadcast(found) if few else found, "key", "left")
    count = lambda on: F.sum(F.when(on, F.col("words")).otherwise(0))
    other = F.col("kind").isNull() & (F.col("words") > 3)
    sums = judged.groupBy("row").agg(count(F.col("kind") == "filler").alias("filler_words"), count(F.col("kind") == "error").alias("error_words"), count(other).alias("other_words"))
    seen = rows.withColumns({"open_slot": has_slot(F.col("text")), "repeats": _repeats(F.col("text"))}).drop("text").join(sums, "row", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = seen.select("doc_id", "open_slot", ((n("filler_words") > 0) | F.col("repeats")).alias("filler"), ((n("error_words") > 0) & (n("other_words") <= STRAY_WORDS)).alias("error_page"))
    return out.where("open_slot or filler or error_page").distinct()
