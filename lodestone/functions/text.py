"""Text expressions: analysis, tests and parsers as Column functions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words of the analyzer; any list can be given instead.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this", "at", "from", "or", "have", "an")


def words(text: Column) -> Column:
    """Runs of letters of any alphabet in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def is_term(word: Column, shortest: int = 2, longest: int = 50, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Within the length bounds and no stop word."""
    return (F.length(word) >= shortest) & (F.length(word) <= longest) & ~word.isin(*stop)


def terms(text: Column, shortest: int = 2, longest: int = 50, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Analyzer: lower case, runs of letters, length bounds, stop words; null gives an empty array."""
    kept = F.filter(words(text), lambda w: is_term(w, shortest, longest, stop))
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_number_or_date(text: Column) -> Column:
    """Only digits, points, per cent and the year, month and day marks, and at least one digit."""
    return F.coalesce(text.rlike("^[0-9.%年月日]+$") & text.rlike("[0-9]"), F.lit(False))


def singular(word: Column) -> Column:
    """For words of over three letters: sses to ss, ies to y, ss stays, a final s goes."""
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.endswith("sses"), F.regexp_replace(word, "sses$", "ss"))
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("ss"), word)
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def categories(wikitext: Column) -> Column:
    """Names in [[Category:name|sort key]] tags, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(wikitext, F.lit(r"(?i)\[\[Category:([^\]|]+)"), F.lit(1)), lambda x: F.trim(x)))


def internal_links(wikitext: Column) -> Column:
    """Targets of [[target|text]] links without a name space, order and repeats kept."""
    return F.transform(F.regexp_extract_all(wikitext, F.lit(r"\[\[([^\]|:#]+)(?:[|#][^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def redirect_target(wikitext: Column) -> Column:
    return F.nullif(F.regexp_extract(wikitext, r"(?i)^\s*#redirect\s*\[\[([^\]|#]+)", 1), F.lit(""))


def accepts_title(title: Column) -> Column:
    """Rejects titles that start with a year (over 7 letters), index and list pages and disambiguation pages."""
    t = F.lower(title)
    year = (F.length(t) > 7) & t.rlike("^[0-9]{4}")
    return ~(year | t.contains("index of ") | t.contains("list of") | t.contains("(disambiguation)"))


def hrefs(html: Column) -> Column:
    """Local link targets of a page, with repeats."""
    return F.coalesce(F.regexp_extract_all(html, F.lit('href="/([^"]*)"'), F.lit(1)), F.array().cast("array<string>"))


def category_redirect(wikitext: Column) -> Column:
    """The name in the first category redirect template."""
    return F.nullif(F.trim(F.regexp_extract(wikitext, r"(?i)\{\{\s*(?:分类重定向|cr)\s*\|([^}|]+)", 1)), F.lit(""))


def commons_tag(wikitext: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(wikitext, r"(?i)\{\{\s*commonscat\s*\|([^}|]+)", 1)), F.lit(""))


def category_title(title: Column) -> Column:
    return F.regexp_replace(title, "(?i)^category:", "")


def is_common_category(title: Column, wikitext: Column, root: str) -> Column:
    """Has a parent category, or is the root."""
    return (F.size(categories(wikitext)) > 0) | (F.lower(category_title(title)) == root.lower())


def plain_text(wikitext: Column) -> Column:
    """Headings and paragraphs as text: templates (however deep), files, categories, references and markup go, links
    leave their label; lines of the kind `key:value` are dropped."""
    depth = F.regexp_count(wikitext, F.lit(r"\{\{"))
    text = F.aggregate(F.sequence(F.lit(0), F.coalesce(depth, F.lit(0))), wikitext, lambda t, _: F.regexp_replace(t, r"\{\{[^{}]*\}\}", ""))
    for pattern, by in (
        (r"(?s)<!--.*?-->", ""),
        (r"(?s)<ref[^>]*/>|<ref.*?</ref>", ""),
        (r"<[^>]+>", ""),
        (r"(?i)\[\[(?:category|file|image):[^\]]*\]\]", ""),
        (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1"),
        (r"\[https?://[^ \]]*\s*([^\]]*)\]", "$1"),
        (r"'{2,}", ""),
        (r"(?m)^\s*=+\s*(.*?)\s*=+\s*$", "$1"),
        (r"(?m)^[*#:;]+\s*", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[^:]+:[^ ]+$"))
    return F.array_join(lines, "\n")


def cleaned(text: Column) -> Column:
    """Lower case, quotes gone; of other signs only one of . @ _ & / - between letters or digits stays."""
    kept = F.regexp_extract_all(F.regexp_replace(F.lower(text), "'", ""), F.lit("[a-z0-9]+(?:[.@_&/-][a-z0-9]+)*"), F.lit(0))
    return F.array_join(kept, " ")


def sentences(text: Column) -> Column:
    """Sentences by their end marks."""
    found = F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def converted(text: Column, source: str, target: str) -> Column:
    """Characters of `source` become those at their place in `target`, as of one script's table to another's."""
    return F.translate(text, source, target)


def han_bigrams(text: Column) -> Column:
    """Pairs of neighbouring Han characters, a run of one standing for itself: needs no dictionary."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))))
    return F.flatten(pairs)


def point(geo: Column) -> Column:
    """(lon, lat) of POINT(lon lat)."""
    part = lambda k: F.regexp_extract(geo, r"POINT\(([-0-9.]+) ([-0-9.]+)\)", k).cast("double")
    return F.struct(part(1).alias("lon"), part(2).alias("lat"))


def coordinate_key(lon: Column, lat: Column) -> Column:
    return F.format_string("%.6f,%.6f", lon, lat)


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _ONE, _MANY, _VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
#: Fixed values of Porter's algorithm, steps 2, 3 and 4: a suffix and what takes its place.
_STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP_4 = "al ance ence er ic able ible ant ement ment ent (s|t)ion ou ism ate iti ous ive ize"


def porter_steps(match: str = "{0} RLIKE '{1}'") -> list[str]:
    """Porter's steps as SQL expressions of a word w; `match` is the engine's test for a regular expression."""

    def test(x: str, pattern: str) -> str:
        return match.format(x, pattern.replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")

    def cut(suffix: str, by: str = "") -> str:
        return f"regexp_replace(w, '{suffix}$', '{by}')"

    def table(rules: str, condition: str) -> str:
        pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
        return "CASE " + " ".join(f"WHEN {test('w', '^.+' + a + '$')} THEN CASE WHEN {test(cut(a), condition)} THEN {cut(a, b)} ELSE w END" for a, b in pairs) + " ELSE w END"

    ion = "regexp_replace(w, 'ion$', '')"
    fourth = "CASE " + " ".join(
        f"WHEN {test('w', '^.+(s|t)ion$')} THEN CASE WHEN {test(ion, _MANY)} THEN {ion} ELSE w END" if a.startswith("(") else f"WHEN {test('w', '^.+' + a + '$')} THEN CASE WHEN {test(cut(a), _MANY)} THEN {cut(a)} ELSE w END"
        for a in sorted(_STEP_4.split(), key=lambda a: -len(a.replace("(s|t)", "")))
    ) + " ELSE w END"
    steps = [
        "regexp_replace(w, '^y', 'Y')",
        f"CASE WHEN {test('w', '^.+(ss|i)es$')} THEN substr(w, 1, length(w) - 2) WHEN {test('w', '^.+[^s]s$')} THEN substr(w, 1, length(w) - 1) ELSE w END",
        # what lost its ending is marked for the repairs of the step after
        f"CASE WHEN {test('w', '^.+eed$')} THEN CASE WHEN {test(cut('eed'), _SOME)} THEN substr(w, 1, length(w) - 1) ELSE w END WHEN {test('w', '^.+(ed|ing)$')} AND {test(cut('(ed|ing)'), _VOWEL)} THEN concat({cut('(ed|ing)')}, '+') ELSE w END",
        f"CASE WHEN NOT {test('w', '[+]$')} THEN w WHEN {test('w', '(at|bl|iz)[+]$')} THEN {cut('[+]', 'e')} WHEN {test('w', '[^aeiouylsz][+]$')} AND length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) THEN substr(w, 1, length(w) - 2) WHEN {test(cut('[+]'), _SHORT)} THEN {cut('[+]', 'e')} ELSE {cut('[+]')} END",
        f"CASE WHEN {test('w', '^.+y$')} AND {test(cut('y'), _VOWEL)} THEN {cut('y', 'i')} ELSE w END",
        table(_STEP_2, _SOME),
        table(_STEP_3, _SOME),
        fourth,
        f"CASE WHEN {test('w', '^.+e$')} AND ({test(cut('e'), _MANY)} OR {test(cut('e'), _ONE)} AND NOT {test(cut('e'), _SHORT)}) THEN {cut('e')} ELSE w END",
        f"CASE WHEN {test('w', 'll$')} AND {test('w', _MANY)} THEN substr(w, 1, length(w) - 1) ELSE w END",
        "regexp_replace(w, '^Y', 'y')",
    ]
    return steps


def stemmed(words: str) -> Column:
    """The words of an array column by Porter's algorithm, a step after the other, all in the JVM."""
    out = words
    for step in porter_steps():
        out = f"transform({out}, w -> {step})"
    return F.expr(out)


def english(text: str, stop: tuple[str, ...] = STOP_WORDS, shortest: int = 2, longest: int = 50) -> Column:
    """The whole analyzer over a text column: words, lower case, Porter stems, stop words (after stemming), length bounds, no
    numbers or dates."""
    words = f"regexp_extract_all(lower({text}), '[a-zà-öø-ÿ0-9.%年月日]+', 0)"
    kept = F.filter(stemmed(words), lambda w: ~w.isin(*stop) & (F.length(w) >= shortest) & (F.length(w) <= longest) & ~is_number_or_date(w))
    return F.coalesce(kept, F.array().cast("array<string>"))
