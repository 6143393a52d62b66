"""Text functions as Columns: they stay in generated code. `\\s` follows Unicode, with U+001C to U+001F as white space too."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f]"
#: CJK ideographs of the three blocks that count for the semantic length, and of the one block for the CJK test.
CJK_THREE_BLOCKS = "[㐀-䶿一-鿿豈-﫿]"
CJK_ONE_BLOCK = "[一-鿿]"
#: Separators trimmed at the edges of cleaned titles.
LEADING_EDGE = r"(?U)^[\-_·丨|>：:.。!！?？,，\s]+"
TRAILING_EDGE = r"(?U)[\-_·丨|>：:\s]+$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"(?U)^{WHITE}+|{WHITE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space, U+3000 included, as one space; none at the ends."""
    return strip(F.regexp_replace(c, f"(?U){WHITE}+", " "))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def semantic_cjk_length(c: Column) -> Column:
    """Number of CJK ideographs."""
    return F.regexp_count(c, F.lit(CJK_THREE_BLOCKS)).cast("int")


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK_ONE_BLOCK)


def has_control_char(c: Column) -> Column:
    return c.rlike(r"\p{Cc}")


def trim_edges(c: Column) -> Column:
    """Collapsed white space, then edge separators off; one pass of each already is the fixpoint."""
    return strip(F.regexp_replace(F.regexp_replace(collapse_whitespace(c), LEADING_EDGE, ""), TRAILING_EDGE, ""))


def occurrences(c: Column, old: str) -> Column:
    """Count of non-overlapping occurrences; an empty string occurs once more than there are characters."""
    if not old:
        return F.char_length(c) + 1
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(old), F.lit("")))) / F.lit(len(old))).cast("int")


def context(c: Column, start: Column, end: Column, width: int = 48) -> Column:
    """The text around a half-open span of code points."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(c, first + 1, end + width - first)


def remove_terms(c: Column, terms: Sequence[str], protected: Mapping[str, str] | None = None) -> Column:
    """Each term removed in turn; a protected one only where the given text does not follow it."""
    for term in terms:
        follows = (protected or {}).get(term)
        quoted = "\\Q" + term + "\\E"
        c = F.regexp_replace(c, f"{quoted}(?!\\Q{follows}\\E)", "") if follows else F.replace(c, F.lit(term), F.lit(""))
    return c


def clean_freetext(c: Column, terms: Sequence[str] = (), suffixes: Sequence[str] = (), protected: Mapping[str, str] | None = None) -> Column:
    """Promotional terms, pictographs (as a space) and quality suffixes off, then the edges."""
    c = remove_terms(c, terms, protected)
    c = F.regexp_replace(c, "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]+", " ")
    if suffixes:
        quoted = "|".join("\\Q" + s + "\\E" for s in sorted(suffixes, key=len, reverse=True))
        c = F.regexp_replace(c, f"(?i)(?:{quoted})+", "")
    return trim_edges(c)


def clean_date_stamps(c: Column, release_words: Sequence[str]) -> Column:
    """Full dates, and a month before a release word, off."""
    c = F.regexp_replace(c, r"\d{4}年\d{1,2}月(?:\d{1,2}日)?", "")
    if release_words:
        c = F.regexp_replace(c, r"\d{1,2}月(?=" + "|".join("\\Q" + w + "\\E" for w in release_words) + ")", "")
    return trim_edges(c)


def clean_truncation(c: Column) -> Column:
    """A trailing `..` or longer off."""
    return trim_edges(F.regexp_replace(c, r"(?U)\.{2,}\s*$", ""))


def strip_prefix(c: Column, prefix: str) -> tuple[Column, Column]:
    """(text without the prefix, whether it was there)."""
    hit = c.startswith(prefix)
    return F.when(hit, F.substring(c, F.lit(len(prefix) + 1), F.char_length(c))).otherwise(c), hit


def translate_map(c: Column, mapping: Mapping[str, str]) -> tuple[Column, Column]:
    """(text with single characters mapped, occurrences of all keys). A longer key counts and is never replaced."""
    single = {k: v for k, v in mapping.items() if len(k) == 1}
    out = F.translate(c, "".join(single), "".join(single.values())) if single and all(len(v) == 1 for v in single.values()) else None
    if out is None:
        out = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in single.items() for y in kv]), x), x)), "") if single else c
    count = F.lit(0)
    for k in mapping:
        count = count + occurrences(c, k)
    return out, count


def lexicon_hits(c: Column, lexicon: Sequence[str]) -> Column:
    """The terms that the text contains, in the order of the lexicon."""
    return F.filter(F.array(*[F.lit(t) for t in lexicon]), lambda t: F.contains(c, t)) if lexicon else F.array().cast("array<string>")


def opaque_id(prefix: str, *parts: Column) -> Column:
    """PREFIX-12HEX from a hash of the parts."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))


def group_hash(c: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def unfenced(c: Column) -> Column:
    """The content of a Markdown code fence, or the text itself."""
    return strip(F.regexp_replace(strip(c), r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", "$1"))


def fixed(c: Column, digits: int = 6) -> Column:
    """Fixed digits; blank for null."""
    return F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit(""))


def percent(c: Column, digits: int = 6) -> Column:
    return fixed(c * 100, digits)


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Values by a map; unknown ones pass."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in mapping.items() for y in kv]), c), c)


def usage(prompt: Column, hit: Column, miss: Column, completion: Column) -> Column:
    """Token usage as struct(hit, miss, output): a missing half of the prompt follows from the other; negative or unknown gives null."""
    h = F.coalesce(hit, prompt - miss, F.lit(0))
    m = F.coalesce(miss, prompt - h)
    ok = (h >= 0) & (m >= 0) & (completion >= 0)
    return F.when(ok, F.struct(h.alias("hit"), m.alias("miss"), completion.alias("output")))


def rule_step(c: Column, rule: Mapping[str, Any]) -> tuple[Column, Column]:
    """(text, replacements) of one declared rule."""
    kind = rule.get("kind")
    if kind == "literal_replace":
        old, new = str(rule["old"]), str(rule.get("new", ""))
        return F.replace(c, F.lit(old), F.lit(new)), occurrences(c, old)
    if kind == "regex_replace":
        pattern = ("(?iuU)" if rule.get("ignore_case") else "(?U)") + str(rule["pattern"])
        return F.regexp_replace(c, pattern, str(rule.get("replacement", ""))), F.regexp_count(c, F.lit(pattern)).cast("int")
    if kind == "character_map":
        if not isinstance(rule.get("mapping"), Mapping):
            raise ValueError("character_map needs a mapping")
        return translate_map(c, rule["mapping"])
    if kind == "collapse_whitespace":
        out = collapse_whitespace(c)
        return out, (out != c).cast("int")
    if kind == "unicode_normalize":
        from corpusloom.functions.udfs import unicode_normalize

        out = unicode_normalize(str(rule.get("form", "NFKC")))(c)
        return out, (out != c).cast("int")
    raise ValueError(f"unsupported rule kind: {kind!r}")
