"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans follow four fixed rules (email, ip, card, phone). Beyond them, high-recall generators propose overlapping
spans in other spellings; boosted trees score each by its format and its neighbourhood, Platt scaling calibrates the
score, and a threshold a kind, set for PRECISION on a part of the labelled examples kept from training, selects. Candidates
that overlap a base span are left out, and in order of their beginnings, of two selected ones that overlap the better stays
(score, length, place, kind); base spans always stay.

The labelled examples are made by rule below and go through the same expressions as the texts, so features can't differ
between training and use; the trees become one SQL expression. Positions come from pairing what a pattern matches with
what lies between the matches; patterns run only on texts that a cheap test lets pass, none of which changes a result.
Unbounded repetitions of groups are possessive, so very long texts don't exhaust the matcher's stack. All steps over a
text's spans are folds in order of place, so a text takes time in proportion to its length and number of spans.

Edge cases: a null text counts as empty (and stays null when redacted); repeated rows are alike; an empty table gives an
empty result; a null id stays null; other columns are kept by ``redacted`` and don't clash, whatever their names.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.folds import chunked, let, offsets, scanned
from sijill.llm import trees

#: In the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Code points on either side of a candidate that its context features see.
AROUND = 32

# The base rules. A match may begin only where a run of its first class begins or the last match ended: any other start
# would reach the same end, so this saves time and changes nothing. Possessive repetitions need no stack and, as what
# follows can't begin with what they repeat, match what greedy ones do.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# The generators: kind, pattern, cheap test.
GENERATORS = (
    ("email", r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++ ?[\[({<] ?(?i:at|@) ?[\])}>] ?[\p{L}\p{N}-]++(?: ?(?:\.|[\[({<] ?(?i:dot|punto|punkt|point|\.) ?[\])}>]) ?[\p{L}\p{N}-]++)++", r"[\[({<] ?(?i:at|@) ?[\])}>]"),
    ("email", r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++", "@"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])", r"[0-9]{4}[._/][0-9]{4}"),
    ("phone", r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[ ./-]?)?\(?[0-9]{2,5}\)?[ ./-]{1,3}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![0-9A-Za-z])", r"[0-9][ ./)-]{1,4}[0-9]{2,4}[ ./-][0-9]{2}"),
)

# Words that stand before personal data and before numbers that are none.
_NEAR = {
    "near_phone": "phone tel telephone call fax mobile cell reach ring whatsapp sms telefon anrufen handy telefono llamar movil telephone appeler portable",
    "near_mail": "mail email e-mail contact write reply correo kontakt courriel adresse send",
    "near_net": "ip ipv6 host server address router gateway client peer ping adresse servidor",
    "near_card": "card visa mastercard amex credit debit payment karte kreditkarte tarjeta carte pay",
    "near_other": "order invoice isbn version page pages date total sum id no number build table row score price vol ref part article section chapter issue bestellung pedido commande",
}


def _words(text: Column, words: str) -> Column:
    pattern = r"(?<![\p{L}])(?:" + "|".join(sorted(words.split())) + r")(?![\p{L}])"
    return F.lower(text).rlike(pattern).cast("double")


# ------------------------------------------------------------------ spans


def _found(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """What ``pattern`` matches, and what lies before, between and behind the matches."""
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(when, F.split(text, pattern, -1))


def _placed(matches: Column, gaps: Column, around: int = 0) -> Column:
    """(start, end, match) of each match, from the lengths of all before it; with ``around``, also ``before`` and ``after``:
    as many code points of the gap beside the match and of the match beyond that."""

    def made(pairs: Column) -> Column:
        starts = offsets(F.transform(pairs, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))))

        def span(x: Column, at: Column, more: list[Column]) -> Column:
            begin = at + F.length(x["g"])
            return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("match"), *more)

        if not around:
            return F.filter(F.zip_with(pairs, starts, lambda x, at: span(x, at, [])), lambda x: x["match"].isNotNull())
        text = F.transform(pairs, lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g")))
        before = F.zip_with(text, F.concat(F.array(F.lit("")), F.transform(pairs, lambda x: F.right(F.coalesce(x["m"], F.lit("")), F.lit(around)))), lambda x, m: F.right(F.concat(m, x["g"]), F.lit(around)))
        after = F.concat(F.slice(F.transform(pairs, lambda x: F.left(F.concat(F.left(x["g"], F.lit(around)), F.coalesce(F.left(x["m"], F.lit(around)), F.lit(""))), F.lit(around))), 2, 1 << 30), F.array(F.lit("")))
        beside = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        whole = F.zip_with(F.zip_with(pairs, starts, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), beside, lambda y, c: span(y["x"], y["at"], [c["b"].alias("before"), c["a"].alias("after")]))
        return F.filter(whole, lambda x: x["match"].isNotNull())

    pairs = F.arrays_zip(matches.alias("m"), gaps.alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,match:string" + (",before:string,after:string>>" if around else ">>"))
    return F.when(F.size(F.coalesce(matches, F.array().cast("array<string>"))) > 0, let(pairs, made)).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _base(text: Column) -> list[tuple[str, Column, Column, object]]:
    """Kind, matches, gaps and the test of a match."""
    card = F.when(text.rlike("[0-9](?:[ -]?[0-9]){13}"), F.lit(True)).otherwise(F.lit(False))
    return [
        ("email", *_found(text, _EMAIL, F.contains(text, F.lit("@"))), lambda m: F.lit(True)),
        ("ip", *_found(text, _IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
        ("card", *_found(text, _CARD, card), lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))),
        ("phone", *_found(text, _PHONE, F.contains(text, F.lit("+"))), lambda m: F.length(_digits(m)).between(10, 15)),
    ]


_SPAN = "array<struct<start:int,kno:int,end:int,kind:string>>"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _good(found: Column, test, kno: int, kind: str) -> Column:
    good = F.filter(found, lambda x: test(x["match"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(kno).alias("kno"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _with_base(rows: DataFrame) -> DataFrame:
    """Adds ``_base``, sorted spans, to rows with ``_text`` (not null)."""
    text = F.col("_text")
    found = _base(text)
    rows = rows.withColumns({f"_{p}{i}": c for i, (_, m, g, _) in enumerate(found) for p, c in (("m", m), ("g", g))})
    spans = []
    for i, (kind, _, _, test) in enumerate(found):
        spans.append(_good(_placed(F.col(f"_m{i}"), F.col(f"_g{i}")), test, i, kind))
    rows = rows.withColumn("_base", F.array_sort(F.concat(*spans)))
    return rows.drop(*[f"_{p}{i}" for i in range(len(found)) for p in "mg"])


def best_apart(found: Column, kind: str, better) -> Column:
    """Spans that don't overlap: in order of their beginnings, of two that do the better stays, ``better(new, old)``.

    ``kind``: the elements' type, a struct that begins with start and end.
    """
    none = F.lit(None).cast(kind)
    last = F.array(none)

    def kept(x: Column) -> Column:
        # the state is the span that stays for now; it is given out when one behind it begins
        apart = lambda s, n: s.isNull() | (n["start"] >= s["end"])
        step = lambda s, n: F.when(apart(s, n) | better(n, s), n).otherwise(s)
        return F.filter(scanned(F.concat(x, last), none, lambda s, n: F.when(n.isNull(), n).otherwise(step(s, n)), lambda s, n: F.when(n.isNull() | apart(s, n), s), kind), lambda s: s.isNotNull())

    return F.when(F.size(found) > 1, kept(F.array_sort(found))).otherwise(found)


# ------------------------------------------------------------------ candidates


def _features(x: Column, generator: int) -> dict[str, Column]:
    m, before, after = x["match"], x["before"], x["after"]
    digits, size = F.length(_digits(m)).cast("double"), F.length(m).cast("double")
    out = {
        "generator": F.lit(float(generator)),
        "size": size,
        "digits": digits,
        "digit_share": digits / F.greatest(size, F.lit(1.0)),
        "separators": F.length(F.regexp_replace(m, r"[\p{L}\p{N}]", "")).cast("double"),
        "kinds_of_separator": F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[\p{L}\p{N}]", ""), ""))).cast("double"),
        "groups": F.size(F.split(m, r"[^\p{L}\p{N}]+")).cast("double"),
        "luhn": F.coalesce(_luhn(_digits(m)), F.lit(False)).cast("double"),
        "brackets": F.contains(m, F.lit("(")).cast("double"),
        "lead_zero": m.rlike(r"^\(?0").cast("double"),
        "three_three_four": m.rlike(r"(?<![0-9])[0-9]{3}[^0-9]{1,3}[0-9]{3}[^0-9][0-9]{4}$").cast("double"),
        "date": m.rlike(r"^(?:(?:19|20)[0-9]{2}[./ -][0-9]{2}[./ -][0-9]{2}|[0-9]{2}[./ -][0-9]{2}[./ -](?:19|20)?[0-9]{2})").cast("double"),
        "digit_before": before.rlike(r"[0-9][^\p{L}]{0,3}$").cast("double"),
        "digit_after": after.rlike(r"^[^\p{L}]{0,3}[0-9]").cast("double"),
    }
    return out | {k: _words(before, w) for k, w in _NEAR.items()}


def _described(found: Column, generator: int, kno: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kno).alias("kno"), *[c.alias(n) for n, c in _features(x, generator).items()]))


def _free(found: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: in order of place, the furthest end of base spans that began before a span's end."""

    def kept(x: Column) -> Column:
        events = F.array_sort(
            F.concat(
                F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("to"), F.lit(-1).alias("no"))),
                F.transform(x, lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("base"), c["start"].alias("to"), i.alias("no"))),
            )
        )
        covered = scanned(events, F.lit(-1), lambda s, e: F.when(e["base"] == 1, F.greatest(s, e["to"])).otherwise(s), lambda s, e: F.when((e["base"] == 0) & (s <= e["to"]), e["no"]).otherwise(-1), "int")
        return let(F.array_sort(F.filter(covered, lambda n: n >= 0)), lambda free: F.transform(free, lambda n: F.get(x, n)))

    return F.when((F.size(found) > 0) & (F.size(base) > 0), let(found, kept)).otherwise(found)


FEATURES = ("generator", "size", "digits", "digit_share", "separators", "kinds_of_separator", "groups", "luhn", "brackets", "lead_zero", "three_three_four", "date", "digit_before", "digit_after", *_NEAR)


def _with_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``_candidates`` (start, end, kno, features) that overlap no base span."""
    text, columns = F.col("_text"), {}
    for i, (_, pattern, test) in enumerate(GENERATORS):
        columns[f"_m{i}"], columns[f"_g{i}"] = _found(text, pattern, F.contains(text, F.lit("@")) if test == "@" else text.rlike(test))
    rows = rows.withColumns(columns)
    found = []
    for i, (kind, _, _) in enumerate(GENERATORS):
        free = _free(_placed(F.col(f"_m{i}"), F.col(f"_g{i}"), AROUND), F.col("_base"))
        found.append(_described(free, i, KINDS.index(kind)))
    return rows.withColumn("_candidates", F.concat(*found)).drop(*columns)


# ------------------------------------------------------------------ labelled examples and training


def examples(n: int = 240, seed: int = 3) -> list[dict]:
    """Sentences with one thing each, and whether it is personal data: ``n`` of every form, from rules."""
    rng = random.Random(seed)
    filler = "the of and in that for with was on and this a on from de la el que die der und les des pour una con".split()

    def d(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def d1(k: int) -> str:
        return rng.choice("123456789") + d(k - 1)

    def luhn(k: int) -> str:
        digits = d1(k - 1)
        return next(digits + c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(digits + c))) % 10 == 0)

    def word() -> str:
        return "".join(rng.choice(["ba", "ne", "lo", "ri", "mu", "sta", "ker", "vin"]) for _ in range(rng.randint(2, 4)))

    def some(k: int) -> str:
        return " ".join(rng.choice(filler) for _ in range(k))

    def near(key: str, often: float) -> str:
        return rng.choice(_NEAR[key].split()) + rng.choice([": ", " ", " at ", " = "]) if rng.random() < often else ""

    sep = lambda: rng.choice([".", "-", " ", "/"])
    forms = {
        (1, "phone"): lambda: near("near_phone", 0.7) + (lambda s: rng.choice([f"({d1(3)}) {d1(3)}-{d(4)}", f"{d1(3)}{s}{d1(3)}{s}{d(4)}", f"00{d1(2)} {d1(3)} {d(3)} {d(4)}", f"0{d1(3)}{s}{d(3)} {d(3)} {d(2)}", f"0{d1(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]))(sep()),
        (0, "phone"): lambda: near("near_other", 0.6) + rng.choice([f"{d(2)}-{d(2)}-20{d(2)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}", f"{d1(2)} {d1(3)} {d1(2)} {d1(4)} {d(3)} {d(2)}", f"{d1(3)}-{d1(3)}-{d1(2)}", f"978-{d(2)}-{d(4)}", f"{d1(4)} {d1(4)} {d1(4)}", f"{d1(2)}.{d1(2)}.{d1(3)}", f"{d1(4)}/{d(2)}/{d(3)}", " ".join(d1(4) for _ in range(rng.randint(4, 6))), " ".join(d1(2) for _ in range(rng.randint(3, 6)))]),
        (1, "card"): lambda: near("near_card", 0.6) + (lambda s, c: rng.choice(["."]).join([c[:4], c[4:8], c[8:12], c[12:]]) if s else "/".join([c[:4], c[4:8], c[8:12], c[12:]]))(rng.random() < 0.7, luhn(16)),
        (0, "card"): lambda: near("near_other", 0.6) + ".".join([d1(4), d(4), d(4), d(rng.choice([1, 3, 4, 6]))]),
        (1, "email"): lambda: near("near_mail", 0.6) + rng.choice([f"{word()}.{word()} [at] {word()} [dot] com", f"{word()}{d(2)}(at){word()}.org", f"{word()} (at) {word()} (dot) {word()} (dot) net", f"{word()}{{at}}{word()}.de", f"{word()}é@{word()}ü.fr", f"{word()}ñ.{word()}@{word()}.es"]),
        (0, "email"): lambda: near("near_other", 0.4) + rng.choice([f"{word()} (at) {rng.choice(filler)}.{d(1)}", f"x (@) {d(1)}.{d(2)}", f"{d(2)} [at] {d(1)}.{d(2)}", f"{word()}é@{d(1)}.{d(1)}"]),
        (1, "ip"): lambda: near("near_net", 0.6) + rng.choice([":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)), f"2001:db8::{rng.randrange(4096, 65536):x}:{rng.randrange(16, 65536):x}", f"fe80::{rng.randrange(4096, 65536):x}:{rng.randrange(4096, 65536):x}:{rng.randrange(4096, 65536):x}"]),
        (0, "ip"): lambda: near("near_other", 0.5) + rng.choice([f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}", f"a:{d(1)}:{d(1)}", f"{d(1)}:{d(1)}:{d(1)}:{d(1)}"]),
    }
    out = []
    for (label, kind), make in forms.items():
        for _ in range(n):
            left, what = some(rng.randint(2, 6)) + " ", make()
            out.append({"text": left + what + " " + some(rng.randint(2, 5)), "label": label, "kind": kind})
    return out


def train(rows: list[dict]) -> tuple[trees.Ensemble, list[float]]:
    """Trees and the threshold of the score for each of KINDS. ``rows``: features, label, kno of candidates."""
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    y = np.array([r["label"] for r in rows])
    kno = np.array([r["kno"] for r in rows])
    held = np.arange(len(rows)) % 4 == 0
    model = trees.boosted(x[~held], y[~held])
    score = model.predict(x[held])
    a, b = trees.platt(score, y[held])
    calibrated = 1 / (1 + np.exp(-(a * np.log(score / (1 - score)) + b)))
    limits = []
    for k in range(len(KINDS)):
        c, t = calibrated[kno[held] == k], y[held][kno[held] == k]
        order = np.argsort(-c, kind="stable")
        fine = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= PRECISION
        limits.append(max(0.5, float(c[order][np.flatnonzero(fine)[-1]])) if fine.any() else 1.1)
    raw = [1 / (1 + np.exp(-(np.log(p / (1 - p)) - b) / a)) if p < 1 else 1.1 for p in limits]  # the limits on the trees' own scale
    return model, [float(r) for r in raw]


@functools.lru_cache(2)
def _model(spark: SparkSession) -> tuple[trees.Ensemble, list[float]]:
    labelled = F.from_json(F.lit(json.dumps(examples())), "array<struct<text:string,label:int,kind:string>>")
    rows = spark.range(1).select(F.posexplode(labelled).alias("n", "e")).select("n", "e.label", "e.kind", F.col("e.text").alias("_text"))
    found = _with_candidates(_with_base(rows)).select("n", "label", "kind", F.explode("_candidates").alias("c")).where("kind = element_at(array('email', 'ip', 'card', 'phone'), c.kno + 1)")
    return train([r.asDict() for r in found.select("label", "c.*", "n").orderBy("n", "start", "end", "generator").collect()])


# ------------------------------------------------------------------ the operator


def spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base`` and ``_all``, sorted arrays of (start, kno, end, kind), and ``_text``, the text or an empty one."""
    model, limits = _model(docs.sparkSession)
    rows = _with_candidates(_with_base(docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))))
    scored = F.transform(
        F.col("_candidates"),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kno"].alias("kno"), model.expression([c[f] for f in FEATURES]).alias("score")),
    )
    limit = F.array(*[F.lit(x) for x in limits])
    chosen = F.filter(scored, lambda c: c["score"] >= F.element_at(limit, c["kno"] + 1))
    rows = rows.withColumn("_chosen", chosen).drop("_candidates")

    rank = lambda s: F.struct(s["score"], s["end"] - s["start"], -s["start"], -s["kno"])
    alone = best_apart(F.col("_chosen"), "struct<start:int,end:int,kno:int,score:double>", lambda new, old: rank(new) > rank(old))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    added = F.transform(alone, lambda c: F.struct(c["start"].alias("start"), c["kno"].alias("kno"), c["end"].alias("end"), F.element_at(kinds, c["kno"] + 1).alias("kind")))
    return rows.withColumn("_all", F.when(F.size("_chosen") > 0, F.array_sort(F.concat("_base", added))).otherwise(F.col("_base"))).drop("_chosen")


def _written(found: str) -> Column:
    return F.array_join(F.transform(F.col(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kno: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kno"] == kno))


def find(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_<kind> (of the base spans), base_sha256, spans."""
    rows = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [_count(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_written("_base"), 256).alias("base_sha256"), _written("_all").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span (overlapping ones: their union) replaced by its kind, and n_chars, if there, made to fit."""
    rows = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = spans(rows)
    # spans of a union with those before: where it begins, or null if an earlier one reaches it, and where what was read so far ends
    fresh = scanned(
        F.col("_all"),
        F.lit(0),
        lambda at, x: F.greatest(at, x["end"]),
        lambda at, x: F.when((at == 0) | (x["start"] >= at), F.struct(at.alias("from"), x["start"].alias("start"), x["kind"].alias("kind"))),
        "struct<from:int,start:int,kind:string>",
    )
    rows = rows.withColumn("_cuts", F.filter(fresh, lambda x: x.isNotNull())).withColumn("_end", F.array_max(F.transform("_all", lambda x: x["end"])))

    def page(c: Column) -> Column:
        """What a chunk of cuts gives, from a part of the text that is copied once a chunk."""
        low = F.element_at(c, 1)["from"]
        part = F.substring(F.col("_text"), low + 1, F.element_at(c, -1)["start"] - low)
        return let(part, lambda p: F.transform(c, lambda x: F.concat(F.substring(p, x["from"] - low + 1, x["start"] - x["from"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))))

    whole = F.concat(F.array_join(F.flatten(F.transform(chunked(F.col("_cuts")), page)), ""), F.substring(F.col("_text"), F.col("_end") + 1, F.length("_text")))
    text = F.when(F.size("_all") > 0, whole).otherwise(F.col("text"))
    rows = rows.withColumn("_new", text)
    size = F.when(F.size("_all") > 0, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    made = {"text": F.col("_new"), "n_chars": size}
    return rows.select(*[made[c].alias(c) if made.get(c) is not None else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
