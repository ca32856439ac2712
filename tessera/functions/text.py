"""Text functions as Column expressions.

Lengths are code points. White space in patterns is ASCII; trimming drops every character up to U+0020.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
#: What trimming drops.
LOW = "".join(map(chr, range(0x21)))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends (``F.trim`` strips spaces only)."""
    return F.btrim(c, F.lit(LOW))


def unix_lines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_text(c: Column) -> Column:
    """Line ends unified, control characters but tab and line ends dropped, three or more line ends as two, trimmed."""
    kept = F.regexp_replace(unix_lines(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return trimmed(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def chunk_source(c: Column, collapse: bool = True) -> Column:
    """What chunkers read: null as empty, line ends unified, trimmed, blank lines collapsed if asked."""
    text = trimmed(unix_lines(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(text, r"\n{3,}", "\n\n") if collapse else text


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return trimmed(F.regexp_replace(c, ASCII_SPACE, " "))


def token_estimate(c: Column) -> Column:
    """A token for every four characters of the squeezed text, at least one, none for a blank text."""
    n = F.length(squeezed(c))
    return F.when(n.isNull() | (n == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(4.0)).cast("int")))


def size_in(c: Column, unit: str) -> Column:
    """Size in ``character`` or ``token`` units; blank texts have none."""
    return token_estimate(c) if unit == "token" else F.when(F.length(trimmed(c)) > 0, F.length(c)).otherwise(F.lit(0))


def window_chars(size: int, unit: str) -> int:
    """Characters of a window of ``size`` units."""
    return max(1, 4 * size) if unit == "token" else size


def content_hash(c: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def chunk_id(doc: Column, order: Column, infix: str = "-") -> Column:
    """``doc-order``, a blank document id being ``document``."""
    name = F.when(doc.isNull() | (trimmed(doc) == ""), F.lit("document")).otherwise(doc)
    return F.concat(name, F.lit(infix), order.cast("string"))


def heading_path(parts: Column) -> Column:
    """Non-blank parts joined by `` > ``."""
    return F.array_join(F.filter(F.transform(parts, trimmed), lambda p: p.isNotNull() & (p != "")), " > ")


def first_seen(terms: Column) -> Column:
    """Terms squeezed, blank ones dropped, later repeats (in any case) dropped, order kept."""
    kept = F.filter(F.transform(terms, squeezed), lambda t: t.isNotNull() & (t != ""))

    def add(held: Column, term: Column) -> Column:
        seen = F.exists(held, lambda h: F.lower(h) == F.lower(term))
        return F.when(seen, held).otherwise(F.concat(held, F.array(term)))

    return F.aggregate(kept, F.array().cast("array<string>"), add)


def keyword_list(response: Column) -> Column:
    """Keywords of a model's answer: a JSON list, fenced or not, else a list parted by commas or lines."""
    bare = trimmed(F.regexp_replace(response, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*\z", ""))
    listed = F.from_json(bare, "array<string>")
    plain = F.split(F.regexp_replace(bare, r'[\[\]"]', ""), r"[,\n]")
    return first_seen(F.when(F.size(listed) > 0, listed).otherwise(plain))


def rewritten_query(response: Column) -> Column:
    """``expanded_query``, ``original_query`` and ``keywords`` of a model's answer: a JSON object, else keywords
    parted by commas, semicolons or lines."""
    bare = trimmed(F.regexp_replace(response, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*\z", ""))
    parsed = F.from_json(bare, "struct<expanded_query:string,original_query:string,keywords:array<string>>")
    is_object = bare.startswith("{")
    words = F.when(is_object, F.coalesce(parsed["keywords"], F.array().cast("array<string>"))).otherwise(F.split(bare, r"[,;\n]+"))
    return F.struct(squeezed(parsed["expanded_query"]).alias("expanded_query"), squeezed(parsed["original_query"]).alias("original_query"), first_seen(words).alias("keywords"))


def enriched_query(query: Column, keywords: Column, limit: int = 10) -> Column:
    """The query followed by keywords not yet in it, up to ``limit`` of them."""
    terms = first_seen(F.concat(F.array(query), F.coalesce(keywords, F.array().cast("array<string>"))))
    return F.array_join(F.slice(terms, 1, limit + 1), " ")


def search_words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def search_tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(search_words(c))


def context_line(number: Column, doc: Column, score: Column, content: Column) -> Column:
    """A numbered context entry."""
    return F.format_string("[%d] docId=%s score=%.3f\n%s\n\n", number, doc, score, content)


def file_extension(name: Column) -> Column:
    """Lower-case extension, null where there is none or the name ends in a dot."""
    ext = F.regexp_extract(name, r"\.([^.]+)\z", 1)
    return F.when(ext != "", F.lower(ext))


def child_names(keys: Column, prefix: str) -> Column:
    """The name that follows a dotted prefix in a property key, null for other keys."""
    start = prefix + "."
    return F.when(keys.startswith(start), F.substring_index(F.substr(keys, F.lit(len(start) + 1)), ".", 1))


def token_usage(usage: Column, name: str, legacy: str) -> Column:
    """A count by its name, else its legacy name, never negative; what is no number counts as missing."""
    return F.greatest(F.lit(0), F.coalesce(usage[name].try_cast("int"), usage[legacy].try_cast("int"), F.lit(0)))
