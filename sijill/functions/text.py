"""Text rules as column functions; each takes and gives a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.functions.folds import let, offsets

#: A word of the lexical measures: letters, digits and underscores of any script, two and more.
TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]{2,}"
ARABIC = r"\x{0600}-\x{06FF}"
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
SENTENCE_END = ".!?؟؛;"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_space(c, drop_nul: bool = False) -> Column:
    """Runs of white space as one blank, none at the ends."""
    c = col(c)
    if drop_nul:
        c = F.replace(c, F.lit("\x00"), F.lit(""))
    return F.trim(F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " "))  # a single blank stays as it is


def strip(c) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clip(c, n: int = 320, empty: str = "") -> Column:
    """At most ``n`` characters of the normalized text, then three dots; ``empty`` if there are none."""
    x = normalize_space(F.coalesce(col(c), F.lit("")))
    return F.when(x == "", F.lit(empty)).when(F.length(x) > n, F.concat(F.rtrim(F.left(x, F.lit(n))), F.lit("..."))).otherwise(x)


def clip_at_word(c, n: int = 320) -> Column:
    """As ``clip``, but cut at the last blank and ended by one ellipsis; inner white space stays."""
    x = F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.left(x, F.lit(n)), " [^ ]*$", ""), F.lit("…")))


def truncate(c, n: int) -> Column:
    return F.regexp_replace(F.left(col(c), F.lit(max(1, n))), r"(?U)^\s+|\s+$", "")


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def token_set(c) -> Column:
    return F.array_distinct(tokens(c))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    same = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def word_tokens(c) -> Column:
    """White-space tokens of two characters and more, each once."""
    return F.array_distinct(F.filter(F.split(col(c), r"(?U)\s+"), lambda x: F.length(x) > 1))


def char_ngrams(c, n: int = 4) -> Column:
    """Overlapping, of the lower-case normalized text; the text itself if it is shorter; none of nothing."""
    x = normalize_space(F.lower(col(c)))
    size = F.length(x)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))


def drop_adjacent(c) -> Column:
    """Without elements that equal the one before."""
    x = col(c)
    return F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1)))


def sentences(c) -> Column:
    """Parts between white space that follows an end mark or a line break; trimmed, without empty ones."""
    parts = F.split(col(c), rf"(?U)(?<=[{SENTENCE_END}\n])\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def normalized_sentences(c) -> Column:
    """``sentences`` of a normalized text: only single blanks part them, so none needs trimming."""
    return F.filter(F.split(col(c), rf" (?<=[{SENTENCE_END}] )"), lambda x: x != "")


def sentences_with_offsets(c) -> Column:
    """(index, text, start, end) of the sentences of the normalized text; code points, end exclusive. Null: none."""
    found = F.coalesce(sentences(normalize_space(c)), F.array().cast("array<string>"))

    def placed(x: Column) -> Column:
        starts = F.transform(offsets(F.transform(x, lambda t: F.length(t) + 1)), lambda at, i: F.struct(i.alias("index"), at.alias("start")))
        return F.zip_with(starts, x, lambda p, t: F.struct(p["index"].alias("index"), t.alias("text"), p["start"].alias("start"), (p["start"] + F.length(t)).alias("end")))

    return let(found, placed)


def within_budget(c, most: int) -> Column:
    """Leading chunks until their kept characters reach ``most``; the one that reaches it is cut and trimmed, and left out if empty."""

    def kept(x: Column) -> Column:
        used = offsets(F.transform(x, lambda s: F.length(s["text"])))
        cut = F.zip_with(x, used, lambda s, u: F.struct(s["index"].alias("index"), F.when(u + F.length(s["text"]) > most, F.trim(F.left(s["text"], F.greatest(most - u, F.lit(0))))).otherwise(s["text"]).alias("text")))
        return F.filter(cut, lambda s: s["text"] != "")

    return let(col(c), kept)


def best_excerpt(c, most: int = 2000, least: int = 50) -> Column:
    """Units joined by line breaks until ``most`` characters; a last one in part only if over ``least`` remain for it."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        room = F.lit(most) - acc["used"]
        fits = F.length(s) <= room
        piece = F.when(fits, s).when(room > least, F.left(s, F.greatest(room, F.lit(0))))
        take = ~acc["full"] & piece.isNotNull()
        return F.struct(F.when(take, acc["used"] + F.length(piece)).otherwise(acc["used"]).alias("used"), (acc["full"] | ~fits).alias("full"), F.when(take, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(col(c), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def has_rtl(c) -> Column:
    return col(c).rlike(RTL)


def arabic_share(c) -> Column:
    """Arabic characters over letters."""
    x = col(c)
    arabic = F.length(x) - F.length(F.regexp_replace(x, f"[{ARABIC}]", ""))
    letters = F.length(x) - F.length(F.regexp_replace(x, r"\p{L}", ""))
    return arabic / F.greatest(letters, F.lit(1)).cast("double")


def is_arabic(c) -> Column:
    return arabic_share(c) > 0.3


def normalize_arabic(c) -> Column:
    """Alef forms as one, no vowel signs, no tatweel, white space collapsed."""
    x = F.translate(col(c), "آأإ", "ااا")
    return normalize_space(F.regexp_replace(x, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", ""))


# Ordinals in both genders and tens, and the bare numbers within compounds.
# fmt: off
NUMBER_WORDS = {
    "الاولى": 1, "الاول": 1,
    "الثانية": 2, "الثاني": 2,
    "الثالثة": 3, "الثالث": 3,
    "الرابعة": 4, "الرابع": 4,
    "الخامسة": 5, "الخامس": 5,
    "السادسة": 6, "السادس": 6,
    "السابعة": 7, "السابع": 7,
    "الثامنة": 8, "الثامن": 8,
    "التاسعة": 9, "التاسع": 9,
    "العاشرة": 10, "العاشر": 10,
    "الحادية عشرة": 11, "الحادي عشر": 11,
    "الثانية عشرة": 12, "الثاني عشر": 12,
    "الثالثة عشرة": 13, "الثالث عشر": 13,
    "الرابعة عشرة": 14, "الرابع عشر": 14,
    "الخامسة عشرة": 15, "الخامس عشر": 15,
    "السادسة عشرة": 16, "السادس عشر": 16,
    "السابعة عشرة": 17, "السابع عشر": 17,
    "الثامنة عشرة": 18, "الثامن عشر": 18,
    "التاسعة عشرة": 19, "التاسع عشر": 19,
    "العشرون": 20, "العشرين": 20,
    "الثلاثون": 30, "الثلاثين": 30,
    "الاربعون": 40, "الاربعين": 40,
    "الخمسون": 50, "الخمسين": 50,
    "الستون": 60, "الستين": 60,
    "السبعون": 70, "السبعين": 70,
    "الثمانون": 80, "الثمانين": 80,
    "التسعون": 90, "التسعين": 90,
    "المائة": 100, "المئة": 100,
}
BARE_WORDS = {
    "واحدة": 1, "واحد": 1,
    "اثنتين": 2, "اثنين": 2, "اثنتان": 2, "اثنان": 2,
    "ثلاث": 3, "ثلاثة": 3,
    "اربع": 4, "اربعة": 4,
    "خمس": 5, "خمسة": 5,
    "ست": 6, "ستة": 6,
    "سبع": 7, "سبعة": 7,
    "ثمان": 8, "ثمانية": 8, "ثماني": 8,
    "تسع": 9, "تسعة": 9,
}
# fmt: on


def _map(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])


def arabic_number(c) -> Column:
    """The number that a text names: all its digits together; else an ordinal, or ordinals joined by "and"; else null."""
    x = normalize_arabic(c)
    digits = F.regexp_replace(F.translate(x, "٠١٢٣٤٥٦٧٨٩", "0123456789"), "[^0-9]", "")
    table, bare = _map(NUMBER_WORDS), _map(BARE_WORDS)
    parts = F.transform(F.split(x, r"(?U)\s+و"), lambda p: F.coalesce(F.try_element_at(table, F.trim(p)), F.try_element_at(bare, F.regexp_replace(F.trim(p), "^ال", ""))))
    total = F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.aggregate(parts, F.lit(0), lambda a, p: a + p))
    whole = F.try_element_at(table, x)
    return F.when(digits != "", digits.try_cast("bigint")).otherwise(F.coalesce(whole, F.when(total != 0, total)).cast("bigint"))


def regulation_name(c) -> Column:
    """The normalized name without a leading kind of regulation."""
    return F.regexp_replace(normalize_arabic(c), r"(?U)^(?:نظام|لائحة|قانون|مرسوم|قرار)\s+", "")


def clean_name(c) -> Column:
    """Without trailing marks, then without one trailing conjunction."""
    x = F.regexp_replace(col(c), r"(?U)[\s،.؛:]+$", "")
    return F.regexp_replace(x, r"(?U)\s+(?:و|أو|في|على|من|إلى)$", "")


#: What opens the facts of a judgment.
FACTS = ("الوقائع", "ملخص القضية", "موضوع الدعوى", "تتلخص وقائع", "تتحصل وقائع")


def facts_section(c, markers: tuple[str, ...] = FACTS, size: int = 1500) -> Column:
    """From the earliest marker on, or from the start; the first ``size`` characters, trimmed."""
    x = col(c)
    at = F.coalesce(F.least(*[F.when(F.instr(x, m) > 0, F.instr(x, m)) for m in markers]), F.lit(1))
    return F.regexp_replace(F.substring(x, at, F.lit(size)), r"(?U)^\s+|\s+$", "")


def entity_tokens(c, n: int = 8) -> Column:
    """The first ``n`` distinct names: a letter, then two and more letters, digits, underscores or hyphens."""
    return F.slice(F.array_distinct(F.regexp_extract_all(col(c), F.lit(rf"[A-Za-z{ARABIC}][A-Za-z0-9{ARABIC}_-]{{2,}}"), F.lit(0))), 1, n)


def bullet_title(c, fallback: str = "") -> Column:
    """A short heading of a sentence: its numbered prefix of 2 to 30 characters, or what stands before a colon, a wide colon or an
    Arabic comma in its first 46, or its first five Arabic words, or ``fallback``."""
    return let(strip(c), lambda x: _title(x, fallback))


def _title(x: Column, fallback: str) -> Column:
    prefix = F.regexp_extract(x, rf"^([٠-٩0-9]+\s*[-:–—]|[{ARABIC}]{{2,10}}\s*[:-])\s*", 1)
    named = let(F.trim(F.regexp_replace(prefix, r"[-:–— ]+$", "")), lambda t: F.when(F.length(t).between(2, 30), t))
    heads = [F.when(F.instr(x, s).between(2, 46), F.nullif(strip(F.left(x, F.instr(x, s) - 1)), F.lit(""))) for s in (":", "：", "،")]
    words = let(F.slice(F.regexp_extract_all(x, F.lit(rf"[{ARABIC}]+"), F.lit(0)), 1, 5), lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")))
    return F.coalesce(named, *heads, words, F.lit(fallback))


def salvage_json(c) -> Column:
    """The text of the outermost object, without code fences; null if there is none."""
    x = F.regexp_replace(col(c), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


# Word families of obligations, risks and affected parties, as patterns.
OBLIGATION = "must|shall|required|obligation|يلتزم|يجب|يتعين|يلزم"
RISK = r"penalty|fine|imprison[\p{L}\p{N}_]*|sanction[\p{L}\p{N}_]*|prohibited|forbidden|يعاقب|غرامة|السجن|الحبس|يحظر|ممنوع"
PARTIES = {
    "أصحاب العمل والمنشآت": "employer|company|منشأة|صاحب العمل",
    "العاملون والموظفون": "employee|worker|عامل|موظف",
    "الجهات التنظيمية والرقابية": "authority|regulator|جهة|وزارة|هيئة",
    "العملاء والمستفيدون": "customer|consumer|عميل|مستفيد",
}


def family(c, words: str) -> Column:
    """Whether any of the words stands in the text by itself."""
    return col(c).rlike(r"(?iU)(?<![\p{L}\p{N}_])(?:" + words + r")(?![\p{L}\p{N}_])")


def severity(c) -> Column:
    return F.when(family(c, RISK), "high").when(family(c, OBLIGATION), "medium").otherwise("low")


def key_dates(c, n: int = 8) -> Column:
    """ISO dates first, then with slashes, then with hyphens; each once, ``n`` at most. Dates stay text."""
    x = col(c)
    found = [F.regexp_extract_all(x, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"), F.lit(0)) for p in (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}")]
    return F.slice(F.array_distinct(F.concat(*found)), 1, n)


def citation_weight(c) -> Column:
    """A sentence's weight as a citation: obligations, penalties and length add; below 1."""
    x = F.when(family(c, OBLIGATION), 0.35).otherwise(0.0) + F.when(family(c, RISK), 0.35).otherwise(0.0)
    return F.least(F.lit(0.99), F.lit(0.25) + x + F.least(F.lit(0.05), F.length(col(c)) / 20000.0))


def citation_relevance(c) -> Column:
    return F.round(citation_weight(c), 3)
