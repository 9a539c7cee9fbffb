"""Text expressions: references, versions, file names, keywords and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake import constants as K


#: Language by file extension.
LANGUAGES = {
    "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++", "cs": "C#", "java": "Java",
    "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "py": "Python", "rb": "Ruby",
    "php": "PHP", "go": "Go", "rs": "Rust", "swift": "Swift", "kt": "Kotlin", "scala": "Scala",
    "sh": "Shell", "pl": "Perl", "lua": "Lua", "sql": "SQL", "html": "HTML", "css": "CSS",
    "groovy": "Groovy", "erl": "Erlang", "m": "Objective-C", "md": "Markdown", "json": "JSON",
}


def words(text: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def cve_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"CVE-\d{4}-\d{4,8}"), F.lit(0))))


def issue_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:#|gh-)(\d{1,6})"), F.lit(1))))


def jira_keys(repository: Column, text: Column) -> Column:
    """Ticket keys; only Apache repositories keep their tickets there."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z]+-\d{1,6}"), F.lit(0))
    keys = F.array_sort(F.array_distinct(F.filter(found, lambda k: ~k.startswith("CVE-"))))
    return F.when(repository.contains("apache"), keys).otherwise(F.array().cast("array<string>"))


def commit_fragments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"/commit/\w{6,40}"), F.lit(0))


def version_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)+)"), F.lit(1))))


def security_keywords(text: Column) -> Column:
    """Listed words that are tokens of the text; listed phrases never are."""
    listed = F.array(*[F.lit(w) for w in K.SECURITY_KEYWORDS])
    return F.array_sort(F.array_intersect(listed, words(F.lower(text))))


def alphanumeric_tokens(text: Column, longer_than: int) -> Column:
    """Distinct lower-case tokens of letters and digits."""
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: F.length(t) > longer_than)))


def product_names(text: Column) -> Column:
    """Capitalised words that do not begin a sentence or line."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?\s] +(\p{Lu}\p{L}{2,})"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def name_tokens(term: Column) -> Column:
    """Lower-case parts of an identifier or path, cut at capitals and non-word characters."""
    spaced = F.regexp_replace(term, "([A-Z])", " $1")
    return F.transform(F.filter(F.split(spaced, r"[\W_]+"), lambda p: p != ""), lambda p: F.lower(p))


def one_line(text: Column, limit: int | None = None) -> Column:
    """Non-blank lines joined by a blank, ends trimmed; optionally only the first characters."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    joined = F.trim(F.array_join(lines, " "))
    return joined if limit is None else F.left(joined, F.lit(limit))


def affected_names(text: Column) -> Column:
    """File-like names of an advisory text: array of ``struct(name, extension)``.

    Per word: outer punctuation and folders go, then a known extension, a dotted name that is no version,
    or a mixed-case, dashed or underscored name decides.
    """
    known = F.array(*[F.lit(e) for e in K.SOURCE_EXTENSIONS])

    def item(name: Column, extension: Column | None = None) -> Column:
        ext = F.lit(None).cast("string") if extension is None else extension
        return F.struct(name.alias("name"), ext.alias("extension"))

    def of_word(word: Column) -> Column:
        dotted = r"(?:(\w{2,})\.)+(\w+)"
        stem, end = F.regexp_extract(word, dotted, 1), F.regexp_extract(word, dotted, 2)
        is_dotted = end != ""
        is_version = word.rlike(r"\d+(?:\.\d+)+")
        mixed = word.rlike(r"[a-zA-Z][a-zA-Z]+[A-Z]\w*|(?:[a-zA-Z]{2,}[_-])+[a-zA-Z]{2,}")
        return (
            F.when(word == "Node.js", F.array().cast("array<struct<name:string,extension:string>>"))
            .when(is_dotted & F.array_contains(known, end), F.array(item(stem, end)))
            .when(is_dotted & ~end.rlike(r"^\d+$") & ~is_version, F.array(item(end), item(stem)))
            .when(mixed, F.array(item(word)))
            .otherwise(F.array().cast("array<struct<name:string,extension:string>>"))
        )

    trimmed = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", ""))
    last = F.transform(trimmed, lambda w: F.element_at(F.split(w, r"[\\/]"), -1))
    return F.flatten(F.transform(last, of_word))


def affected_files(text: Column) -> Column:
    """Distinct file-like names, at least one character."""
    names = F.transform(affected_names(text), lambda i: i["name"])
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.length(n) > 0)))


def affected_extensions(text: Column) -> Column:
    found = F.transform(affected_names(text), lambda i: i["extension"])
    kept = F.filter(found, lambda e: e.isNotNull() & ~e.isin(K.EXTENSIONS_NOT_SEARCHED))
    return F.array_sort(F.array_distinct(kept))


def is_real_version(text: Column) -> Column:
    return text.rlike(r"^\d+\.(?:\d+\.*)*\d")


def language(path: Column, code: Column) -> Column:
    """Language by file extension, ``unknown`` without code or for an unlisted extension."""
    pairs = [F.lit(x) for entry in LANGUAGES.items() for x in entry]
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    known = F.try_element_at(F.create_map(*pairs), extension)
    return F.when(F.coalesce(F.trim(code), F.lit("")) != "", F.coalesce(known, F.lit("unknown"))).otherwise("unknown")


def line_range(code: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a source text."""
    return F.array_join(F.slice(F.split(code, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def html_text(html: Column) -> Column:
    """Text of a page: comments and tags removed, common entities replaced."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def blank_to_null(col: Column) -> Column:
    """Empty text and the text ``None`` stand for a missing value."""
    return F.when(~F.coalesce(col, F.lit("")).isin("", "None"), col)


def packed(id: Column) -> Column:
    """An id as bytes, half as many where it is lower-case hex; equal ids only have equal bytes.  See ``unpacked``."""
    raw = F.unhex(id)
    return F.when(F.lower(F.hex(raw)) == id, F.concat(F.unhex(F.lit("00")), raw)).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(id, "UTF-8")))


def unpacked(bytes: Column) -> Column:
    """The id that :func:`packed` made ``bytes`` of."""
    rest = F.substring(bytes, 2, 0x7FFFFFFF)
    return F.when(F.substring(bytes, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
