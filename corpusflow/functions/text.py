"""Column expressions over document text and metadata."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space stripped from both ends of a string.
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
# Greeting per hour range [from, to).
DAY_PARTS = [(5, 12, "Good morning"), (12, 17, "Good afternoon"), (17, 21, "Good evening")]
DAY_PART_OTHER = "Hello"
# Reference tags at the start or the end of a passage, complete or damaged.
REF_START = r"\A(?:<#)?(?:ref)?(\d+)(?:#>?)?"
REF_END = r"(?:<#)?(?:ref)?(\d+)(?:#>?)?\z"
REF_BOTH = r"(?s)\A<#ref(\d+)#>(.*)<#ref\1#>\z"


def strip(c: Column) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.btrim(c, F.lit(SPACE))


def source_hash(source_type: Column, name: Column) -> Column:
    """Namespace of a configured source."""
    return F.concat(source_type, F.lit("-"), F.md5(F.lower(name)), F.lit(".source"))


def memory_namespace(name: Column, kind: Column) -> Column:
    """Namespace of a memory table."""
    return F.concat(F.lower(strip(kind)), F.lit("-"), F.md5(F.lower(strip(name))))


def git_source(meta: Column) -> Column:
    """Browsable link of a repository file; plain ``source`` when a part is missing."""
    link = F.concat(
        F.regexp_replace(meta["url"], r"\.git\z", ""), F.lit("/-/blob/"),
        meta["branch"], F.lit("/"), meta["source"],
    )
    return F.coalesce(link, meta["source"])


def citation_source(meta: Column) -> Column:
    """Repository link for git documents, ``source`` for all others."""
    return F.when(meta["url"].contains(".git"), git_source(meta)).otherwise(meta["source"])


def snippet(text: Column, title: Column) -> Column:
    """The title, or the text up to its first full stop."""
    opening = F.concat(F.substring_index(strip(text), ".", 1), F.lit(" ..."))
    return F.coalesce(F.nullif(title, F.lit("")), opening)


def wrap_refs(text: Column, i: Column) -> Column:
    """Mark a passage with its position so that metadata can be found again later."""
    tag = F.concat(F.lit("<#ref"), i.cast("string"), F.lit("#>"))
    return F.concat(F.lit("\n\n"), tag, F.lit(" "), F.replace(text, F.lit("\n\n"), F.lit("\n")),
                    F.lit(" "), tag, F.lit("\n\n"))


def extract_ref(c: Column, compat: bool = True) -> tuple[Column, Column]:
    """``(clean text, ref id)`` of a marked passage; -1 without a tag, null text when blank.

    ``compat`` looks for a tag, even a damaged one, at the start, then at the end, and removes
    the one found first. Otherwise only a complete pair of tags counts and both are removed.
    """
    body = strip(c)
    blank = body == ""
    if not compat:
        pair = body.rlike(REF_BOTH)
        text = F.when(pair, strip(F.regexp_extract(body, REF_BOTH, 2))).otherwise(body)
        ref = F.when(pair, F.regexp_extract(body, REF_BOTH, 1).try_cast("bigint"))
    else:
        head, tail = F.regexp_extract(body, REF_START, 0), F.regexp_extract(body, REF_END, 0)
        text = (F.when(head != "", strip(F.substr(body, F.length(head) + 1)))
                .when(tail != "", strip(F.left(body, F.length(body) - F.length(tail))))
                .otherwise(body))
        ref = F.regexp_extract(F.when(head != "", head).otherwise(tail), r"\d+", 0).try_cast("bigint")
    return F.when(~blank, text), F.when(~blank, F.coalesce(ref, F.lit(-1).cast("bigint")))


def parse_queries(c: Column) -> Column:
    """A list literal of strings, single or double quoted, as an array."""
    return F.from_json(strip(c), "array<string>")


def with_source_suffix(message: Column, source: Column) -> Column:
    return strip(F.concat(message, F.lit(" %"), strip(F.coalesce(source, F.lit("none"))), F.lit("%")))


def parse_source_suffix(c: Column) -> tuple[Column, Column]:
    """``(message, source label)``; the label is ``none`` when no ``%label%`` ends the message."""
    pattern = r"(?s)\A(.*)%([^%]*)%\z"
    found = c.rlike(pattern)
    return (F.when(found, strip(F.regexp_extract(c, pattern, 1))).otherwise(c),
            F.when(found, strip(F.regexp_extract(c, pattern, 2))).otherwise(F.lit("none")))


def day_part(ts: Column) -> Column:
    hour = F.hour(ts)
    out = None
    for start, end, word in DAY_PARTS:
        inside = (hour >= start) & (hour < end)
        out = F.when(inside, word) if out is None else out.when(inside, word)
    return out.otherwise(DAY_PART_OTHER)


def file_parts(path: Column) -> tuple[Column, Column]:
    """``(base name, extension with its dot)``; leading dots start no extension."""
    name = F.substring_index(path, "/", -1)
    return name, F.regexp_extract(name, r"(?s)[^.].*(\.[^.]*)\z", 1)


def field_or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def tokens(c: Column) -> Column:
    """Lower-case words between blanks, tabs and line ends."""
    return F.filter(F.split(F.lower(c), r"[ \t\r\n]+"), lambda t: t != "")


def content_key(text: Column, meta: Column) -> Column:
    """Identity of a document: its text and its metadata, whatever the order of the map; null counts as empty."""
    entries = F.coalesce(F.to_json(F.array_sort(F.map_entries(meta))), F.lit("[]"))
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\x01"), entries), 256)
