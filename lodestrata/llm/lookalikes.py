"""One form for strings that a reader cannot tell apart.

A string first loses what no reader sees (invisible characters, kinds of
space, width of letters and digits, ways to write an accent).  Then tokens
are repaired by script: in a token of mixed scripts, or one that is foreign to
its text, look-alike letters are replaced by those of one script, but only
where the result occurs as a plain token somewhere in the corpus.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut_lineage, sent_if_small

#: Look-alike letters; the string under a script lists its letters in the order of ``LATIN``.
LATIN = "aeopcyxijshqwdl" + "ABEKMHOPCTXIJSYGQW" + "vpojc" + "ABEZHIKMNOPTYXC" + "o"
FOREIGN = "аеорсухіјѕһԛԝԁӏ" + "АВЕКМНОРСТХІЈЅҮԌԚԜ" + "νροϳϲ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ" + "օ"

#: Ranges of the characters above by script.
SCRIPTS = {"cyrillic": (0x0400, 0x052F), "greek": (0x0370, 0x03FF), "armenian": (0x0530, 0x058F)}

#: Look-alikes of Latin letters that stand in a text of another script.
TO_LATIN = str.maketrans(FOREIGN, LATIN)
TO_SCRIPT = {
    name: str.maketrans({a: b for a, b in zip(reversed(LATIN), reversed(FOREIGN)) if low <= ord(b) <= high})
    for name, (low, high) in SCRIPTS.items()
}

_WIDE = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
_ALIKE = [*range(0x2E80, 0x2FD6), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), 0x0132, 0x0133]
_HYPHENS = "‐‑"

#: Characters that need Unicode's composition or have a plain equal of another length.
_COMPOSE = r"[\p{M}\x{0132}\x{0133}\x{0340}-\x{0345}\x{0374}\x{037E}\x{0387}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2126}\x{212A}\x{212B}\x{2160}-\x{217F}\x{2329}\x{232A}\x{F900}-\x{FAFF}\x{FB00}-\x{FB06}\x{2F800}-\x{2FA1F}]"

#: Joiners shape the letters of these scripts, so they stay there.
_INVISIBLE = (
    r"(?<![\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}])[\x{200C}\x{200D}]"
    r"|[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{180B}-\x{180F}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}\x{0001}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}]"
)

#: A string without any of these holds nothing invisible.
_HIDDEN = r"[\p{Cf}\p{Cc}\x{034F}\x{115F}\x{1160}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}&&[^\n]]"
_SPACES = "\t\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_BREAKS = "\u0085\u2028\u2029"

_TOKEN = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}\p{M}]+"
_SUSPECT = r"[\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}]"


def _plain(char: str) -> str:
    return unicodedata.normalize("NFKC", char)


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    alike = {c: _plain(chr(c)) for c in [*range(0x2160, 0x2180), *range(0xFB00, 0xFB07), 0x0132, 0x0133]}
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.translate(alike)))


def visible_form(text: Column) -> Column:
    """The string without what a reader does not see; accents, case, raised digits and punctuation stay."""
    single = [c for c in [*_WIDE, *_ALIKE] if len(_plain(chr(c))) == 1 and _plain(chr(c)) != chr(c)]
    source = "".join(map(chr, single)) + _HYPHENS + _SPACES + _BREAKS
    target = "".join(_plain(chr(c)) for c in single) + "-" * len(_HYPHENS) + " " * len(_SPACES) + "\n" * len(_BREAKS)
    # Each step runs only on strings that need it.
    wide = text.rlike(r"[^\x0A\x20-\x7F]")
    form = F.when(text.rlike(_HIDDEN), F.regexp_replace(text, _INVISIBLE, "")).otherwise(text)
    form = F.translate(F.when(form.contains("\r"), F.regexp_replace(form, "\r\n?", "\n")).otherwise(form), source, target)
    # Only strings that need it cross over to Python.
    composed = F.coalesce(_composed(F.when(wide & form.rlike(_COMPOSE), form)), form)
    form = F.btrim(F.when(wide, composed).otherwise(text), F.lit(" \n"))
    return F.when(form.contains(" \n"), F.regexp_replace(form, r" +(?=\n)", "")).otherwise(form)


def _script(char: str) -> str | None:
    code = ord(char)
    for name, (low, high) in SCRIPTS.items():
        if low <= code <= high:
            return name
    return "latin" if char.isalpha() else None


def repairs(token: str, text_script: str) -> list[str]:
    """What a token may stand for, the likeliest first: its letters in the text's script, then in its own dominant script, then in its others."""
    parts = unicodedata.normalize("NFD", token)
    counts: dict[str, int] = {}
    for char in parts:
        script = _script(char)
        if script:
            counts[script] = counts.get(script, 0) + 1
    scripts = sorted(counts, key=lambda s: (-counts[s], s))
    if len(scripts) < 2 and text_script in scripts:
        return []
    found = []
    for target in dict.fromkeys([text_script, *scripts]):
        latin = parts.translate(TO_LATIN)
        result = latin if target == "latin" else latin.translate(TO_SCRIPT.get(target, {}))
        if all(_script(c) in (None, target) for c in result):
            form = unicodedata.normalize("NFC", result)
            if form != token and form not in found:
                found.append(form)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repairs(tokens: pd.Series, scripts: pd.Series) -> pd.Series:
    return pd.Series([repairs(t, s) for t, s in zip(tokens, scripts)])


def consistent_form(df: DataFrame, key: list[str], text: str, corpus: DataFrame | None = None, corpus_text: str = "form") -> DataFrame:
    """``key`` columns and ``form``, equal exactly for strings that read the same.

    ``corpus`` gives the vocabulary (default: the strings themselves); its column
    ``corpus_text`` holds visible forms.  Null stays null; empty and invisible
    strings become empty; every row of ``df`` stays.
    """
    # Read three times below; keys and forms are as large as the strings at most.
    base = cut_lineage(df.select(*key, visible_form(F.col(text)).alias("form")))
    words = (base if corpus is None else corpus).select(F.col("form" if corpus is None else corpus_text).alias("form"))

    letters = lambda kind: F.length(F.regexp_replace("form", rf"[^{kind}]", ""))
    suspect = F.coalesce(F.col("form").rlike(_SUSPECT), F.lit(False))
    doubted, plain = base.filter(suspect), base.filter(~suspect)
    latin, greek, cyrillic = letters(r"\p{IsLatin}"), letters(r"\p{IsGreek}"), letters(r"\p{IsCyrillic}")
    # A text that is mostly Chinese, or whose foreign letters are all look-alikes, counts as Latin.
    disguised = ~F.translate("form", FOREIGN, "").rlike(_SUSPECT)
    script = F.when(disguised | ((latin >= greek) & (latin >= cyrillic)), "latin").when(cyrillic >= greek, "cyrillic").otherwise("greek")
    # Pieces alternate between tokens and what lies between them.
    cut = F.split(F.regexp_replace("form", f"({_TOKEN})", "\u0001$1\u0001"), "\u0001")
    pieces = doubted.select("form").distinct().withColumn("script", script).select("form", "script", F.posexplode(cut).alias("n", "piece"))
    pieces = pieces.withColumn("token", F.when(F.col("piece").rlike(_SUSPECT), F.col("piece")))
    asked = pieces.filter("token is not null").select("token", "script").distinct()
    options = asked.select("token", "script", F.posexplode(_repairs("token", "script")).alias("rank", "option"))

    tokens = words.select(F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(f"({_TOKEN})"), 1))).alias("option"))
    # Tokens of one script only may vouch for a repair.
    pure = tokens.filter(~F.col("option").rlike(_SUSPECT) | F.col("option").rlike(r"^(?:[\p{IsGreek}\p{M}]+|[\p{IsCyrillic}\p{M}]+|[\p{IsArmenian}\p{M}]+)$"))
    known = options.join(pure.distinct(), "option", "left_semi")
    chosen = known.groupBy("token", "script").agg(F.min_by("option", "rank").alias("repair"))

    # Only the doubtful tokens of doubtful strings move; the others would share one empty key.
    fixed = pieces.filter("token is not null").join(chosen, ["token", "script"]).select("form", "n", "repair")
    fixed = fixed.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("n", "repair"))).alias("repairs"))
    joined = doubted.join(fixed, "form", "left")
    repaired = F.when(F.col("repairs").isNull(), F.col("form")).otherwise(
        F.array_join(F.transform(cut, lambda piece, n: F.coalesce(F.try_element_at("repairs", n), piece)), "")
    )
    return plain.select(*key, "form").unionByName(joined.select(*key, repaired.alias("form")))


def string_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def alike_pairs(forms: DataFrame) -> DataFrame:
    """From (field_name, record_key, raw_id, form): pairs of ids whose strings differ but have one form.

    ``raw_id`` identifies the string as it is stored (see ``string_id``).  Pairs arise only between different strings of one form, never among the
    records that share a string.
    """
    # Written once: ids and hashes, of which five steps read.
    marked = cut_lineage(
        forms.filter(F.col("form").isNotNull() & F.col("record_key").isNotNull()).select("field_name", "record_key", F.unhex(F.md5("form")).alias("form_id"), "raw_id")
    )
    groups = marked.groupBy("field_name", "form_id").agg(F.min("raw_id").alias("low"), F.max("raw_id").alias("high"))
    # Forms of two strings or more are few beside all; a form that very many records share moves only if it is one of them.
    several = sent_if_small(cut_lineage(groups.filter(F.col("low") != F.col("high")).select("field_name", "form_id")))
    members = cut_lineage(marked.join(several, ["field_name", "form_id"], "left_semi").distinct())
    strings = members.select("field_name", "form_id", "raw_id").distinct()
    pairs = strings.withColumnRenamed("raw_id", "raw_a").join(strings.withColumnRenamed("raw_id", "raw_b"), ["field_name", "form_id"]).filter("raw_a < raw_b")
    left = members.select("field_name", "form_id", F.col("raw_id").alias("raw_a"), F.col("record_key").alias("a"))
    right = members.select("field_name", "form_id", F.col("raw_id").alias("raw_b"), F.col("record_key").alias("b"))
    joined = pairs.join(left, ["field_name", "form_id", "raw_a"]).join(right, ["field_name", "form_id", "raw_b"])
    return joined.filter("a != b").select("field_name", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def alike_classes(forms: DataFrame) -> DataFrame:
    """(field_name, form_id, record_key, n_records, n_strings): the class of every record whose string has look-alikes, and the class's size.

    The pairs of ``alike_pairs`` follow from it: records of one class with
    different strings.
    """
    marked = cut_lineage(
        forms.filter(F.col("form").isNotNull() & F.col("record_key").isNotNull()).select("field_name", "record_key", F.unhex(F.md5("form")).alias("form_id"), "raw_id").distinct()
    )
    strings = marked.groupBy("field_name", "form_id", "raw_id").agg(F.count(F.lit(1)).alias("n"))
    classes = strings.groupBy("field_name", "form_id").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_strings")).filter("n_strings > 1")
    return marked.join(sent_if_small(cut_lineage(classes)), ["field_name", "form_id"]).select("field_name", F.hex("form_id").alias("form_id"), "record_key", "n_records", "n_strings").distinct()
