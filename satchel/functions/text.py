"""Text shaping with Spark SQL expressions alone: addresses, names, headers, vCard and mbox lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(text, r"\s", " ")) != "", text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def dequote(name: Column) -> Column:
    """What stands between a leading and the last single quote, else the name."""
    return F.when(name.rlike(r"^'.*'"), F.regexp_extract(name, r"^'(.*)'", 1)).otherwise(name)


def address(name: Column, email: Column) -> Column:
    """`"name" <email>` if there are both and they differ, else the one there is."""
    both = (F.coalesce(name, F.lit("")) != "") & email.isNotNull() & (name != email)
    return F.when(both, F.concat(F.lit('"'), name, F.lit('" <'), email, F.lit(">"))).otherwise(F.coalesce(email, name))


def sender_address(addrtype: Column, name: Column, email: Column, transport_from: Column) -> Column:
    """The From header: from SMTP properties, else the transport header, else made up from an X.400 address, else the name."""
    user = F.when(name.isNotNull(), F.regexp_replace(name, "(.*), (.*)", "$2.$1")).otherwise(F.lower(F.regexp_extract(email, r"(\w+)$", 1)))
    organisation = F.regexp_extract(email, "(?i)^/O=([^/]+)", 1)
    domain = F.when(organisation != "", F.concat(F.lower(organisation), F.lit(".com"))).otherwise(email)
    mailbox = F.concat(F.lit("<"), user, F.lit("@"), domain, F.lit(">"))
    made = F.when(email.isNotNull(), F.when(name.isNotNull(), F.concat(F.lit('"'), name, F.lit('" '), mailbox)).otherwise(mailbox)).when(name.isNotNull(), F.concat(F.lit('"'), name, F.lit('"')))
    both = name.isNotNull() & email.isNotNull() & (name != email)
    smtp = F.when(both, F.concat(F.lit('"'), name, F.lit('" <'), email, F.lit(">"))).otherwise(F.coalesce(email, name))
    return F.when(F.coalesce(addrtype, F.lit("")) == "SMTP", smtp).otherwise(F.coalesce(transport_from, made))


def safe_filename(name: Column) -> Column:
    """Blanks and all characters but letters, digits and .()[]{}- become underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9.()\[\]{}-]", "_")


def combined_filename(path: Column, name: Column) -> Column:
    """Name of a combined output for a folder: the path with dots for slashes, then the extension; dots are squeezed."""
    extension = F.concat(F.lit("."), F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.regexp_replace(F.concat(safe_filename(F.translate(path, " /", "_.")), extension), r"\.+", ".")


def normalize_path(path: Column) -> Column:
    """Slashes for backslashes, runs of them collapsed, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "^/|/$", "")


def under_path(path: Column, prefix: Column) -> Column:
    """True if path is the prefix or below it, in any case of letters."""
    p, x = F.lower(path), F.lower(normalize_path(prefix))
    return (p == x) | F.startswith(p, F.concat(x, F.lit("/")))


def mime_type(message_class: Column) -> Column:
    return (
        F.when(message_class == "IPM.Contact", "text/x-vcard").when(message_class == "IPM.Note", "message/rfc822")
        .when(message_class.isin("IPM.Post", "IPM.StickyNote"), "text/plain")
    )


def extension(mime: Column) -> Column:
    return F.when(mime == "text/x-vcard", "vcf").when(mime == "message/rfc822", "eml").when(mime == "text/plain", "txt")


def short_type(message_class: Column) -> Column:
    return F.when(message_class.rlike(r"IPM\."), F.lower(F.regexp_extract(message_class, r"IPM\.(.*)", 1)))


def subject_without_prefix(subject: Column) -> Column:
    """Without the two-character marker that store subjects may start with."""
    return F.when(F.startswith(subject, F.lit("\x01")), F.substring(subject, 3, 1 << 30)).otherwise(subject)


def vcard_escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\,;])", r"\\$1"), "\n", r"\\n")


def fold(line: Column, width: int = 75) -> Column:
    """A line cut after every `width` characters; what follows starts with a blank, which counts."""
    first = F.substring(line, 1, width)
    rest = F.regexp_replace(F.substring(line, width + 1, 1 << 30), f"(?s)(.{{1,{width - 1}}})", "\n $1")
    return F.concat(first, rest)


def mboxrd(text: Column) -> Column:
    """`>` before each line that is `From ` after any number of `>`."""
    return F.regexp_replace(text, "(?m)^(>*From )", ">$1")


def from_mboxrd(text: Column) -> Column:
    """What mboxrd was made from."""
    return F.regexp_replace(text, "(?m)^>(>*From )", "$1")


def rfc2822(time: Column) -> Column:
    return F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss Z")


def header_block(message: Column) -> Column:
    """What stands before the first empty line."""
    return F.element_at(F.split(message, "\r?\n\r?\n", 2), 1)


def message_body(message: Column) -> Column:
    """What stands after the first empty line, empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(message, "\r?\n\r?\n", 2), F.lit(2)), F.lit(""))


def parse_headers(block: Column) -> Column:
    """Array of (name, value) in order. Lines that start with a tab or a blank go on; white space collapses to a blank."""
    lines = F.split(F.regexp_replace(block, "\r?\n[\t ]+", " "), "\r?\n")
    good = F.filter(lines, lambda x: x.rlike(r"^\S+:"))
    value = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"(?s)^\S+?:\s*(.*)", 1), r"\s+", " "))
    return F.transform(good, lambda x: F.struct(F.regexp_extract(x, r"^(\S+?):", 1).alias("name"), value(x).alias("value")))


def header_values(headers: Column, name: str) -> Column:
    """All values of a header, by exact name, in order."""
    return F.transform(F.filter(headers, lambda h: h["name"] == name), lambda h: h["value"])


def header_joined(headers: Column, name: str) -> Column:
    """Values of a header joined by blanks; null if there is none."""
    found = header_values(headers, name)
    return F.when(F.size(found) > 0, F.array_join(found, " "))


def header_map(headers: Column) -> Column:
    """All values of each header by exact name, in order."""
    names = F.array_distinct(F.transform(headers, lambda h: h["name"]))
    values = lambda n: F.transform(F.filter(headers, lambda h: h["name"] == n), lambda h: h["value"])
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, values(n))))


def header_main(value: Column) -> Column:
    """A structured header's value without its attributes."""
    return F.trim(F.regexp_extract(value, "^[^;]+", 0))


_ATTRIBUTE = r";\s*([^\s=;]+)\s*=\s*(\"[^\"]*\"|[^\s;]*)"


def header_attributes(value: Column) -> Column:
    """Attributes of a structured header as a map; of a repeated one the first counts."""
    keys = F.regexp_extract_all(value, F.lit(_ATTRIBUTE), F.lit(1))
    values = F.transform(F.regexp_extract_all(value, F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    items = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(items, lambda x, i: F.array_position(F.transform(items, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(first)


def is_multipart(content_type: Column) -> Column:
    return F.coalesce(F.startswith(content_type, F.lit("multipart")), F.lit(False))


def boundary(item: Column, part: Column) -> Column:
    """A boundary that depends on the item and the part's place alone, so that repeated runs agree."""
    return F.concat(F.lit("----_=_NextPart_"), F.lpad(part.cast("string"), 3, "0"), F.lit("_"), F.substring(F.sha2(F.concat_ws("/", item.cast("string"), part.cast("string")), 256), 1, 16))


def boundary_of(content_type: Column) -> Column:
    """The boundary that a content type names, null if there is none."""
    found = F.regexp_extract(content_type, r"(?i);\s*boundary\s*=\s*(\"[^\"]*\"|[^\s;]*)", 1)
    return F.nullif(F.regexp_replace(found, '^"|"$', ""), F.lit(""))


def _boundary_line(mark: Column, closing: bool) -> Column:
    """The pattern of a boundary: a line of its own, blanks behind it aside, with the line end before it."""
    quoted = F.concat(F.lit("(?:\\A|\r?\n)--\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(quoted, F.lit("--" if closing else ""), F.lit("[ \t]*(?=\r?\n|\\z)"))


def around_end(body: Column, mark: Column) -> Column:
    """What stands before and behind the closing boundary of a multipart body; one text if there is none."""
    return F.split(body, _boundary_line(mark, True), 2)


def between_boundaries(half: Column, mark: Column) -> Column:
    """What stands between the boundaries of a multipart body without its closing boundary; the preamble comes first."""
    return F.split(half, _boundary_line(mark, False))


def parts_found(halves: Column, pieces: Column) -> Column:
    """preamble, parts, epilogue and closed, of what around_end and between_boundaries give."""
    start = lambda p: F.when(F.startswith(p, F.lit("\r\n")), F.substring(p, 3, 1 << 30)).when(F.startswith(p, F.lit("\n")), F.substring(p, 2, 1 << 30)).otherwise(p)
    parts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start)
    return F.struct(F.element_at(pieces, 1).alias("preamble"), parts.alias("parts"), start(F.try_element_at(halves, F.lit(2))).alias("epilogue"), (F.size(halves) > 1).alias("closed"))


def split_parts(body: Column, mark: Column) -> Column:
    """preamble, parts, epilogue and closed of a multipart body. A boundary is a line of its own, blanks behind it aside; the line
    end before it is part of it. What stands behind the closing boundary is the epilogue, null if there is no closing boundary
    (closed is false then). Of a null body all are null."""
    halves = around_end(body, mark)
    return parts_found(halves, between_boundaries(F.element_at(halves, 1), mark))


def split_multipart(body: Column, mark: Column, built: bool = True) -> Column:
    """preamble, parts and epilogue, as split_parts gives them. built: the body is of joined_parts, which writes two line ends behind
    a part; the second one is taken off as well."""
    found = split_parts(body, mark)
    own = (lambda p: F.regexp_replace(p, r"\r?\n\z", "")) if built else (lambda p: p)
    return F.struct(found["preamble"].alias("preamble"), F.transform(found["parts"], own).alias("parts"), found["epilogue"].alias("epilogue"))
