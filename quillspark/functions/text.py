"""Scalar text functions as Column expressions: normal forms, fingerprints, keys, escapes, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed value: what mail programs set before the subject of a reply or a forwarded mail.
REPLY_MARKS = ("re", "fw", "fwd", "aw", "sv", "vs")
REPLY_PREFIX = rf"^(?:(?:{'|'.join(REPLY_MARKS)})\s*(?:\[\d+\])?\s*:\s*)+"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(t: ColumnOrName) -> Column:
    """Lower case, each run of Unicode white space as one space, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(_c(t)), r"(?U)\s+", " "))


def short_hash(t: ColumnOrName) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(_c(t), 256), 1, 16)


def content_hash(t: ColumnOrName) -> Column:
    """Fingerprint of a text that ignores case and white space."""
    return short_hash(normalize(t))


def lines(t: ColumnOrName) -> Column:
    return F.split(F.replace(_c(t), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def line_hashes(t: ColumnOrName, least: int = 16) -> Column:
    """Distinct fingerprints, in order, of the lines whose normal form has at least ``least`` characters."""
    kept = F.filter(F.transform(lines(t), normalize), lambda x: F.length(x) >= least)
    return F.array_distinct(F.transform(kept, short_hash))


def note_id(project: ColumnOrName, target: ColumnOrName, text: ColumnOrName) -> Column:
    """Id of a note: project, target (null as empty) and text, in this order."""
    return short_hash(F.concat_ws("|", _c(project), F.coalesce(_c(target), F.lit("")), _c(text)))


def pair_id(path_a: ColumnOrName, ordinal_a: ColumnOrName, path_b: ColumnOrName, ordinal_b: ColumnOrName) -> Column:
    """Id of a pair of chunks, the same for either order of the two."""
    a, b = F.concat_ws("#", _c(path_a), _c(ordinal_a).cast("string")), F.concat_ws("#", _c(path_b), _c(ordinal_b).cast("string"))
    return short_hash(F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def normalize_path(p: ColumnOrName) -> Column:
    """A file path with slashes, in lower case; a key with a scheme (``jira://``) stays as it is."""
    c = F.trim(_c(p))
    return F.when(c.rlike(r"^[a-z]+://"), c).otherwise(F.lower(F.translate(c, "\\", "/")))


def ticket_key(key: ColumnOrName) -> Column:
    return F.concat(F.lit("jira://"), F.upper(F.trim(_c(key))))


def page_key(page: ColumnOrName) -> Column:
    return F.concat(F.lit("confluence://"), F.trim(_c(page).cast("string")))


def file_name(p: ColumnOrName) -> Column:
    return F.element_at(F.split(_c(p), "/"), -1)


def kind(p: ColumnOrName) -> Column:
    """``jira`` or ``confluence`` by the scheme, else the extension in lower case, else ``(no extension)``."""
    c = _c(p)
    ext = F.regexp_extract(F.lower(c), r"\.([^./]+)$", 1)
    return F.when(c.startswith("jira://"), "jira").when(c.startswith("confluence://"), "confluence").when(ext != "", ext).otherwise("(no extension)")


def slug(t: ColumnOrName, most: int = 80) -> Column:
    """Runs of letters and digits in lower case, joined by hyphens, cut at ``most`` characters."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(_c(t)), r"[^\p{L}\p{Nd}]+", "-"), "^-+", "")
    return F.regexp_replace(F.substring(joined, 1, most), "-+$", "")


def excerpt(t: ColumnOrName, most: int = 240) -> Column:
    """One line of at most ``most`` characters, with an ellipsis where it was cut."""
    c = F.trim(F.regexp_replace(_c(t), r"\r?\n", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def inline(t: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_c(t), r"[\r\n]+", " "))


def escape_headings(t: ColumnOrName) -> Column:
    """A backslash before what would read as a heading."""
    return F.regexp_replace(_c(t), r"(?m)^(#{1,6}\s)", r"\\$1")


def escape_cell(t: ColumnOrName, backslash: bool = False) -> Column:
    """A value for a pipe table: bars escaped (and backslashes, for query results), line breaks as spaces."""
    c = F.replace(_c(t), F.lit("\\"), F.lit("\\\\")) if backslash else _c(t)
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", " "))


def without_reply_prefix(subject: ColumnOrName) -> Column:
    return F.regexp_replace(_c(subject), f"(?i){REPLY_PREFIX}", "")


def mentions(t: ColumnOrName) -> Column:
    """Distinct ticket keys in a text, in upper case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(t), F.lit(r"(?i)\b[A-Z][A-Z0-9]+-\d+\b"), F.lit(0)), F.upper))


def key_project(key: ColumnOrName) -> Column:
    """The project of a ticket key (``AEXP`` of ``AEXP-19``), null for what is no key."""
    return F.when(_c(key).rlike(r"^[A-Za-z][A-Za-z0-9]*-\d+$"), F.upper(F.substring_index(_c(key), "-", 1)))


def identifier(t: ColumnOrName) -> Column:
    """An SQL name without the quotes or brackets of its parts."""
    return F.array_join(F.transform(F.split(F.trim(_c(t)), r"\."), lambda p: F.regexp_replace(F.trim(p), r'^["`\[]+|["`\]]+$', "")), ".")


def table_key(t: ColumnOrName) -> Column:
    """What two names of one table have in common: the last part, in lower case."""
    return F.lower(F.element_at(F.split(identifier(t), r"\."), -1))


def site_url(t: ColumnOrName) -> Column:
    """Scheme and host of an address, ``https`` where it has no scheme; null for a blank one."""
    c = F.trim(_c(t))
    full = F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.when(c != "", F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)))


def page_ids(t: ColumnOrName) -> Column:
    """Distinct page ids that a body links to."""
    return F.array_distinct(F.regexp_extract_all(_c(t), F.lit(r"/pages/(\d+)"), F.lit(1)))


def markdown_title(md: ColumnOrName) -> Column:
    """The first heading's text, or null."""
    got = F.regexp_extract(_c(md), r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    return F.when(got != "", got)


def tidy_markdown(md: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(_c(md), F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def api_timestamp(t: ColumnOrName) -> Column:
    """A time stamp with or without a colon in its offset; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(_c(t), r"([+-]\d{2})(\d{2})$", "$1:$2"))


def pdf_timestamp(t: ColumnOrName) -> Column:
    """``D:20260702134500+02'00'``; at least the day must be there."""
    m = lambda i: F.regexp_extract(_c(t), r"^(?:D:)?(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?", i)
    z = lambda i: F.when(m(i) == "", "00").otherwise(m(i))
    offset = F.when(m(8) == "", "Z").otherwise(F.concat(m(8), z(9), F.lit(":"), z(10)))
    return F.when(m(3) != "", F.try_to_timestamp(F.concat(m(1), F.lit("-"), m(2), F.lit("-"), m(3), F.lit("T"), z(4), F.lit(":"), z(5), F.lit(":"), z(6), offset)))


def honest_title(t: ColumnOrName) -> Column:
    """A typeset file's own title, trimmed; null where it is blank, a path, a single word with a file's extension, or text whose letters are mostly doubled."""
    title = F.trim(F.regexp_replace(_c(t), r"^(?U)\s+|(?U)\s+$", ""))
    letters = F.regexp_replace(title, r"[^\p{L}]", "")
    n = F.length(letters)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2)), lambda i: (F.substr(letters, i, F.lit(1)) == F.substr(letters, i + 1, F.lit(1))).cast("int"))
    doubled = (n >= 6) & (2 * F.aggregate(pairs, F.lit(0), lambda a, x: a + x) >= 0.7 * n)
    file_like = title.rlike(r"[/\\]") | title.rlike(r"^[^ ]+\.[\p{L}\p{Nd}]{1,5}$")
    return F.when((title != "") & ~file_like & ~doubled, title)


def days_between(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact distance of two time stamps in days, as DOUBLE."""
    return F.abs(F.unix_micros(_c(a)) - F.unix_micros(_c(b))) / F.lit(86_400_000_000.0)


def natural_key(t: ColumnOrName) -> Column:
    """A sort key by which ``Item 9`` comes before ``Item 10``: digit runs padded, letters in lower case."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(_c(t), F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")


def strip_breadcrumb(content: ColumnOrName, heading: ColumnOrName) -> Column:
    """The text of a chunk's content: nothing where it is the heading alone, what follows the heading, or all of it."""
    c, h = _c(content), _c(heading)
    lead = F.concat(h, F.lit("\n\n"))
    return F.when(c == h, "").when(c.startswith(lead), F.substr(c, F.length(lead) + 1, F.length(c))).otherwise(c)


def with_breadcrumb(heading: ColumnOrName, text: ColumnOrName) -> Column:
    h, t = F.coalesce(_c(heading), F.lit("")), F.coalesce(_c(text), F.lit(""))
    return F.when(t == "", h).when(h == "", t).otherwise(F.concat(h, F.lit("\n\n"), t))
