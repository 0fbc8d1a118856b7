"""WARC derivatives: metadata and plain-text conversion records linked to responses.

Each response gives a metadata record (title, links, what the source's HTTP headers said)
and a conversion record (its visible text). Both refer to the response's record id, carry
its target address, date, HTTP headers and payload digest, and have digests and lengths of
their own blocks. Record ids are name-based, so reruns give the same archive.

Every pattern is linear in the page: an opener that is not closed is given up at the next
``<`` (of a tag) or at the next opener of its kind (of a script, style, comment and the
like), so hostile pages cost no more than others.

Defined cases: a null address or page counts as an empty one and still gives both records;
repeated rows give repeated records with equal ids; numeric entities become their character
(none: U+FFFD), named ones beyond the tables below stay as written; line breaks in link
targets, languages and addresses are written as %0D and %0A, so that they end no field;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWLED = "2024-01-01T00:00:00Z"
#: The names of the characters U+00A0 to U+00FF, in their order.
LATIN_1 = """
nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest
Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig
agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml
""".split()
#: Further names and their characters; a no-break space is written as a blank.
ENTITIES = {name: chr(160 + i) for i, name in enumerate(LATIN_1)} | {
    "nbsp": " ", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„",
    "euro": "€", "trade": "™", "bull": "•", "dagger": "†", "Dagger": "‡", "permil": "‰", "lsaquo": "‹", "rsaquo": "›", "OElig": "Œ", "oelig": "œ", "Scaron": "Š", "scaron": "š", "Yuml": "Ÿ", "fnof": "ƒ", "circ": "ˆ", "tilde": "˜", "ensp": " ", "emsp": " ", "thinsp": " ",
}
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_HIDDEN = ("script", "style", "noscript", "template", "head")
_BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside|blockquote|pre|hr|form|title|body|html"
# up to the closing tag, or given up at the next opener of the same kind
UNSEEN = rf"(?i)<(?:({'|'.join(_HIDDEN)})\b[^<]*+(?:<(?!/?\1\b)[^<]*+)*+</\1\s*+>|!--[^<-]*+(?:(?:-(?!->)|<(?!!--))[^<-]*+)*+-->)"
BREAKS = rf"(?i)</?(?:{_BLOCKS})\b[^<>]*+>"
TAGS = "<[^<>]*+>"
TITLE = r"(?i)<title\b[^<>]*+>([^<]*+)</title"
LINKS = r"(?i)<a\b[^<>]*?\bhref\s*+=\s*+[\"']([^\"'<>]*+)[\"']"
LANG = r"(?i)<html\b[^<>]*?\blang\s*+=\s*+[\"']([^\"'<>]*+)[\"']"


def named_uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def character(number: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    exists = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
    code = F.when(exists, number).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """Text with its entities replaced, each once: what a replacement writes is not read
    again. Texts without an ampersand are left alone."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(m: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(m, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        decimal = F.regexp_extract(m, "^&#([0-9]+)", 1).try_cast("int")
        number = F.when(m.rlike("^&#[xX]"), hexadecimal).otherwise(decimal)
        name = F.substring_index(F.substring_index(m, ";", 1), "&", -1)
        return F.when(m.startswith("&#"), character(number)).otherwise(F.coalesce(F.try_element_at(names, name), m))

    parts, marks = F.split(text, ENTITY, -1), F.transform(F.regexp_extract_all(text, F.lit(ENTITY), 0), one)
    joined = F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return F.when(F.instr(text, "&") > 0, joined).otherwise(text)


def one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def stripped(html: Column) -> Column:
    """The page without scripts, styles, comments and tags; block tags break lines."""
    t = F.regexp_replace(html, UNSEEN, " ")
    t = F.regexp_replace(F.translate(t, "\t\r\n\f", "    "), BREAKS, "\n")
    return F.regexp_replace(t, TAGS, "")


def plain_text(stripped_page: Column) -> Column:
    """Visible text of a stripped page (a column that is computed already: it is used
    several times): entities become characters, runs of blanks shrink to one."""
    t = decoded(stripped_page)
    t = F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r" ?\n[ \n]*", "\n")
    return F.trim(t, F.lit(" \n"))


def responses_from_pages(pages: DataFrame, crawled: str = CRAWLED) -> DataFrame:
    """(page_id, record_id, target_uri, date, http_headers, payload, payload_digest): crawled
    pages as response records."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", url.alias("target_uri"), html.alias("payload"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    rows = rows.withColumns({"date": F.lit(crawled), "http_headers": head, "payload_digest": digest(F.col("payload"))})
    return rows.withColumn("record_id", named_uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")))


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for every response: (key, record_type, record_id, refers_to, target_uri,
    date, content_type, source_headers, source_digest, block, block_digest, content_length)."""
    html = F.col("payload")
    links = F.col("_links")
    # each is found once and used several times
    found = responses.withColumns({"_links": F.regexp_extract_all(html, F.lit(LINKS), 1), "_stripped": stripped(html)})
    media = F.regexp_extract("http_headers", r"(?i)content-type:[ \t]*([^\r\n]*)", 1)
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    title = F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"[ \t\r\n\f]+", " ")
    meta = F.concat(
        field("title", title), field("language", one_line(F.regexp_extract(html, LANG, 1))), field("source-status", status), field("source-content-type", media),
        field("outlinks", F.size(links).cast("string")), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), one_line(x), F.lit("\r\n"))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("_stripped")).alias("block")),
    )
    rows = found.select(F.col(key), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    rows = rows.withColumns({"record_id": named_uuid(F.col("record_type"), F.col("refers_to")), "block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    return rows.select(key, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "block", "block_digest", "content_length")


def write(records: DataFrame, path: str) -> None:
    """Records as WARC files, one per partition: every row is a whole record (its own
    headers, the source's payload digest and HTTP headers folded into one field)."""
    folded = F.regexp_replace(F.regexp_replace("source_headers", r"[\r\n]+$", ""), r"[\r\n]+", "; ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"),
        F.lit("\r\nWARC-Target-URI: "), one_line(F.col("target_uri")), F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\nWARC-Source-Payload-Digest: "), F.col("source_digest"),
        F.lit("\r\nWARC-Source-Headers: "), folded, F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"),
    )
    records.select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], str, bool]]:
    """(headers, block, whole) of the records of one file, each as long as its
    Content-Length says; values of a repeated header are joined. ``whole`` is false for a
    record that the file's end cuts off. Reading ends where no record follows."""
    at = 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: dict[str, str] = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name] = f"{headers[name]}; {value.strip()}" if name in headers else value.strip()
        stated = headers.get("Content-Length", "")
        start, length = end + 4, int(stated) if stated.isdecimal() else 0
        block = raw[start : start + length]
        yield headers, block.decode("utf-8", "replace"), len(block) == length
        at = start + length
        while raw[at : at + 2] == b"\r\n":
            at += 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block, whole) of the records of WARC files, read by their lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = list(records_of(raw.as_py()))
                headers = pa.array([list(h.items()) for h, _, _ in rows], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([headers, pa.array([x for _, x, _ in rows], pa.string()), pa.array([w for _, _, w in rows], pa.bool_())], names=["headers", "block", "whole"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "headers map<string,string>, block string, whole boolean")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _uuid_sql(x: str) -> str:
    return f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"


#: Plain patterns for an engine whose search is linear by itself.
SQL_UNSEEN = "(?is)<(?:script\\b.*?</script|style\\b.*?</style|noscript\\b.*?</noscript|template\\b.*?</template|head\\b.*?</head)\\s*>|<!--.*?-->"
SQL_BREAKS = rf"(?i)</?(?:{_BLOCKS})\b[^<>]*>"
SQL_TITLE = r"(?i)<title\b[^<>]*>([^<]*)</title"
SQL_LINKS = r"(?i)<a\b[^<>]*?\bhref\s*=\s*[\"']([^\"'<>]*)[\"']"
SQL_LANG = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']([^\"'<>]*)[\"']"


def _decoded_sql(x: str) -> str:
    """Entities replaced one by one, from the split text and its marks side by side."""
    names = "map {" + ", ".join(f"{_q(n)}: {_q(c)}" for n, c in ENTITIES.items()) + "}"
    number = "case when m[3] in ('x', 'X') then try_cast('0x' || m[4:-2] as int) else try_cast(m[3:-2] as int) end"
    char = f"case when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr({number}) else chr(65533) end"
    mark = f"case when m is null then '' when m[2] = '#' then {char} else coalesce({names}[m[2:-2]], m) end"
    pieces = f"list_zip(string_split_regex({x}, {_q(ENTITY)}), regexp_extract_all({x}, {_q(ENTITY)}))"
    return f"list_reduce(list_transform({pieces}, lambda z: z[1] || list_transform([z[2]], lambda m: {mark})[1]), lambda a, b: a || b)"


def _text_sql(x: str) -> str:
    x = f"regexp_replace({x}, {_q(SQL_UNSEEN)}, ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g'), {_q(SQL_BREAKS)}, chr(10), 'g')"
    x = _decoded_sql(f"regexp_replace({x}, '<[^<>]*>', '', 'g')")
    x = f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


#: DuckDB SQL for the derivatives of ``pages``.
DERIVATIVES_SQL = f"""
with p as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload, 'sha256:' || sha256(coalesce(html, '')) as source_digest from pages),
r as (select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) as source_headers,
  'response|' || coalesce(page_id::varchar, '') || '|' || target_uri || '|' || source_digest as rname from p),
i as (select *, {_uuid_sql('rname')} as refers_to, regexp_extract_all(payload, {_q(SQL_LINKS)}, 1) as links from r),
b as (
  select *, 'metadata' as record_type, 'application/warc-fields' as content_type,
    'title: ' || regexp_replace(regexp_extract(payload, {_q(SQL_TITLE)}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g') || chr(13) || chr(10) || 'language: ' || replace(replace(regexp_extract(payload, {_q(SQL_LANG)}, 1), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
    || 'source-status: 200' || chr(13) || chr(10) || 'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'outlinks: ' || len(links) || chr(13) || chr(10)
    || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || replace(replace(x, chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)), ''), '') as block from i
  union all
  select *, 'conversion', 'text/plain; charset=utf-8', {_text_sql('payload')} from i),
n as (select *, record_type || '|' || refers_to as dname from b)
select page_id, record_type, {_uuid_sql('dname')} as record_id, refers_to, target_uri, {_q(CRAWLED)} as date, content_type, source_headers, source_digest, block,
  'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length from n
"""
