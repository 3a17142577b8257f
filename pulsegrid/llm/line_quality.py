"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged by five rules: navigation (separators), boilerplate (phrases), symbols, punctuation
(exclamation marks throughout, or a long line without any closing mark) and shouting. Failing lines are removed, and a
document that loses too much of its text is rejected. Counts of the whole document reject it before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import GAP_CHARS, WORD, fresh, without, words

SYMBOLS, SEPARATORS, CLOSING = "#*$%&|<>", "|»·•", ".!?…:;。！？"
#: A character of a word.
VISIBLE = WORD.rstrip("+")
#: Phrases of lines that aren't content, by language; a line is lower-cased before it is searched.
PHRASES = {
    "en": ("licensed under", "licenced under", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum", "subscribe", "click here", "read more"),
    "de": ("lizenziert unter", "alle rechte vorbehalten", "urheberrecht", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "hier anmelden", "jetzt registrieren", "hier klicken", "weiterlesen"),
    "fr": ("sous licence", "tous droits réservés", "droit d'auteur", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "se connecter", "inscrivez-vous", "cliquez ici", "lire la suite"),
    "es": ("bajo la licencia", "todos los derechos reservados", "derechos de autor", "condiciones de uso", "política de privacidad", "aviso legal", "iniciar sesión", "regístrate", "haz clic", "leer más"),
}
#: Phrases that end with a word; the text around them decides.
BOUNDED = ("sign in", "sign up", "login", "log in")
BOILERPLATE = "|".join([*(p for phrases in PHRASES.values() for p in phrases), *(rf"{p}\b" for p in BOUNDED)])
#: A document is rejected when its failing lines hold more than this share (in percent) of its characters in words.
MOST_LOST = 40
MIN_WORDS, MOST_REPEATED = 50, 50


#: One of these stands in every text in which BOILERPLATE can be found.
HINTS = (*(p for phrases in PHRASES.values() for p in phrases), *BOUNDED)


def _any_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&|" else c for c in chars) + "]"


def _count(x: Column, chars: str) -> Column:
    return F.regexp_count(x, F.lit(_any_of(chars)))


def line_failure(line: Column, hinted: Column, marked: Column, exclaimed: Column) -> Column:
    """The name of the first rule that a line fails, or null.

    The last three say of the whole text whether it holds a phrase, a symbol and an exclamation mark at all; lines of
    texts without them skip the dearer tests.
    """
    size = F.length(line)
    parts = f"(?s){_any_of(SEPARATORS)}.*?{_any_of(SEPARATORS)}.*?{_any_of(SEPARATORS)}"
    return (
        F.when(line.rlike(parts), "navigation")
        .when(hinted & F.lower(line).rlike(BOILERPLATE), "boilerplate")
        .when(marked & (_count(line, SYMBOLS) * 20 > size), "symbols")
        .when(exclaimed & (size >= 20) & (_count(line, "!") * 20 > size) | (size >= 200) & ~line.rlike(_any_of(CLOSING)), "punctuation")
        .when((size >= 20) & ~line.rlike("[a-z]") & (F.upper(line) == line) & (F.lower(line) != line), "shouting")
    )


def windows(w: Column) -> Column:
    """The three-word windows of an array of words as (hash, position), sorted."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    three = F.arrays_zip(F.slice(w, F.lit(1), n).alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c"))
    return F.sort_array(F.transform(three, lambda t, i: F.struct(F.xxhash64(t["a"], t["b"], t["c"]).alias("h"), i.alias("i"))))


def repeated_words(order: Column) -> Column:
    """Words that stand in windows found twice or more, first included; from the sorted windows."""
    later = F.slice(order, F.lit(2), F.size(order))
    none = F.array().cast("array<int>")
    at = F.sort_array(F.array_distinct(F.flatten(F.zip_with(order, later, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(none)))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")))["n"]


def judge_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_chars, kept and
    clean_text (the text without its failing lines).

    A null text has no words and is rejected by the base rules, as an empty one; its clean text is empty. Rows are
    judged each on its own, without a shuffle; columns of these names are replaced; an empty table gives none.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_chars", "kept", "clean_text")
    kept = without(docs, *names)
    t, w, lines, order, grams, n_words, n_symbols, hinted, exclaimed = fresh(docs, "text_", "words_", "lines_", "order_", "grams_", "count_", "marks_", "hinted_", "exclaimed_")
    long = lambda c: c.cast("long")
    text = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(t))
    low = F.lower(t)
    has_hint = F.lit(False)
    for h in HINTS:
        has_hint = has_hint | low.contains(h)
    cut = text.select("*", words(F.col(t)).alias(w), F.split(t, "\n", -1).alias(lines), has_hint.alias(hinted), _count(F.col(t), SYMBOLS).alias(n_symbols), F.contains(F.col(t), F.lit("!")).alias(exclaimed))
    visible = F.filter(lines, lambda x: x.rlike(VISIBLE))
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_failure(x, F.col(hinted), F.col(n_symbols) > 0, F.col(exclaimed)).alias("rule")))
    parted = cut.select(*kept, n_symbols, F.size(w).alias(n_words), F.length(F.array_join(w, "")).alias(t), windows(F.col(w)).alias(grams), visible.alias(lines), judged.alias(order))
    counted = parted.select(
        *kept,
        long(F.col(n_words)).alias("n_words"),
        long(F.col(t)).alias("word_chars"),
        long(F.col(n_symbols)).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        long(repeated_words(F.col(grams))).alias("n_repeat_words"),
        order,
    )
    lost = F.aggregate(order, F.lit(0).cast("long"), lambda s, x: s + F.when(x["rule"].isNotNull(), F.length(F.translate(x["line"], GAP_CHARS, ""))).otherwise(0))
    left = F.array_join(F.transform(F.filter(order, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost.alias("failed_chars"), left.alias("clean_text")).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("failed_chars") <= MOST_LOST * F.col("word_chars"))
    )


def _sql_count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


_FAILS = f"""{_sql_count("x", SEPARATORS)} >= 3 or regexp_matches(lower(x), '{BOILERPLATE.replace("'", "''")}') or {_sql_count("x", SYMBOLS)} * 20 > length(x)
      or ({_sql_count("x", "!")} * 20 > length(x) and length(x) >= 20) or (length(x) >= 200 and {_sql_count("x", CLOSING)} = 0)
      or (length(x) >= 20 and upper(x) = x and lower(x) <> x)"""

ORACLE = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as lines from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from g) where n > 1),
rep as (select doc_id, count(distinct i + x)::bigint as n from twice, (values (0), (1), (2)) v(x) group by doc_id),
f as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    {_sql_count("t", SYMBOLS)}::bigint as n_symbols, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as v,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x: {_FAILS}), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')))), 0)::bigint as failed_chars,
    md5(coalesce(array_to_string(list_filter(lines, lambda x: not ({_FAILS})), chr(10)), '')) as clean_md5
  from d),
b as (
  select f.doc_id, n_words, word_chars, n_symbols, (len(v) - len(list_distinct(v)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, failed_chars, clean_md5
  from f left join rep using (doc_id))
select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * failed_chars <= {MOST_LOST} * word_chars as kept
from b
"""
