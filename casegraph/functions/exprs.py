"""Scalar column expressions shared by normalisation and detection.

All of them are built-in Spark expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import fixed_values as fv

def null_string() -> Column:
    return F.lit(None).cast("string")


# ------------------------------------------------------------------ regular expressions
def java(pattern: str, flags: str = "idU") -> str:
    """Inline flags giving the pattern its intended meaning on the JVM.

    i: no regard to case; d: only ``\\n`` ends a line; U: ``\\w``, ``\\s``, ``\\b`` and case
    follow Unicode.
    """
    return f"(?{flags}){pattern}" if flags else pattern


def matches(text: Column, pattern: str) -> Column:
    """True where ``pattern`` occurs in ``text``; null text does not match."""
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def group(text: Column, pattern: str, index: int = 1, flags: str = "idU") -> Column:
    """Capture group of the first match, null without one; the text is evaluated once."""
    return F.get(F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(index)), F.lit(0))


# ------------------------------------------------------------------ text clean-up
_SPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(text, F.lit(_SPACE))


def non_empty(text: Column) -> Column:
    """The text, null if it is empty.

    ``nullif`` names its argument twice, and inside a branch Spark evaluates it twice, so nested calls
    would double the work at each level.  An array of one element names it once.
    """
    return F.get(F.array_remove(F.array(text.cast("string")), F.lit("")), F.lit(0))


def clean(text: Column) -> Column:
    """Trimmed lower-case text; empty becomes null."""
    return non_empty(F.lower(strip(text)))


def _last_part(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def basename(text: Column) -> Column:
    """Last path segment in lower case, for either slash; empty becomes null."""
    return non_empty(_last_part(F.lower(strip(text))))


def process_name(text: Column) -> Column:
    """Like :func:`basename` after removing surrounding quotes."""
    return non_empty(_last_part(F.lower(F.trim(strip(text), F.lit("'\"")))))


def domain_name(text: Column) -> Column:
    return non_empty(F.translate(F.lower(strip(text)), "\\/", ""))


def task_name(text: Column) -> Column:
    return clean(F.translate(text, "'\\", ""))


def account_user(text: Column) -> Column:
    """User part of ``DOMAIN\\user``."""
    return non_empty(strip(F.regexp_replace(strip(text), r"^[^\\]*\\", "")))


def account_domain(text: Column) -> Column:
    """Domain part of ``DOMAIN\\user``; null without a backslash."""
    return non_empty(strip(F.regexp_extract(strip(text), r"^([^\\]*)\\", 1)))


# ------------------------------------------------------------------ numbers and times
def hex_to_int(text: Column) -> Column:
    """Integer of a hexadecimal text of any length; null where its value exceeds 64 bits."""
    digits = F.regexp_extract(F.lower(strip(text)), "^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    return F.conv(non_empty(digits), 16, 10).try_cast("bigint")


def logon_id(text: Column) -> Column:
    """Canonical ``0x…`` form of a hexadecimal logon id."""
    raw = F.lower(F.trim(strip(text), F.lit("'\"")))
    return F.concat(F.lit("0x"), non_empty(F.regexp_extract(raw, "^(?:0x)?0*([0-9a-f]+)$", 1)))


def pid(text: Column) -> Column:
    """Integer process id; text that is not a number becomes null, and so does numeric 0."""
    return strip(text.cast("string")).try_cast("bigint")


def snapshot_pid(text: Column) -> Column:
    """Snapshots carry numbers, and 0 means that there is none."""
    return F.nullif(pid(text), F.lit(0).cast("bigint"))


def port(text: Column) -> Column:
    return strip(text.cast("string")).try_cast("int")


def iso_time(text: Column) -> Column:
    """ISO-8601 time; anything else, a missing value included, becomes null."""
    return F.try_to_timestamp(strip(text))


def ms_date(text: Column) -> Column:
    """``/Date(ms)/`` or ``d<ms>``; null up to 2000-01-01."""
    digits = F.coalesce(
        non_empty(F.regexp_extract(text, r"/Date\((\d+)\)/", 1)),
        non_empty(F.regexp_extract(text, r"d(\d+)", 1)),
    )
    millis = digits.try_cast("bigint")
    return F.when(millis > fv.EARLIEST_MS_DATE, F.timestamp_millis(millis))


def ms_date_text(text: Column) -> Column:
    """The digits of a ``/Date(ms)/`` text whatever their size; null for another form."""
    return non_empty(F.regexp_extract(text, r"/Date\((-?\d+)\)/", 1))


def task_date(text: Column) -> Column:
    """The only date form of scheduled tasks, ``/Date(ms)/``."""
    millis = non_empty(F.regexp_extract(text, r"/Date\((\d+)\)/", 1)).try_cast("bigint")
    return F.when(millis > fv.EARLIEST_MS_DATE, F.timestamp_millis(millis))


def access_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def error_time(text: Column) -> Column:
    """Error-log time; the weekday is dropped first, the day may be one digit."""
    body = F.regexp_replace(F.regexp_replace(strip(text), r"^\w{3}\s+", ""), r"\s+", " ")
    parts = F.regexp_extract(body, r"^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})\.(\d{1,6}) (\d{4})$", 2)
    head = F.regexp_extract(body, r"^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})\.(\d{1,6}) (\d{4})$", 1)
    year = F.regexp_extract(body, r"^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2})\.(\d{1,6}) (\d{4})$", 3)
    joined = F.concat_ws(" ", head, F.rpad(parts, 6, "0"), year)
    return F.when(head != "", F.try_to_timestamp(joined, F.lit("MMM d HH:mm:ss SSSSSS yyyy")))


# ------------------------------------------------------------------ key-value text
def key_values(message: Column, delimiter: str = ";") -> Column:
    """``k=v;k=v`` as a map: the first ``=`` splits, both sides trimmed, the last key wins."""
    parts = F.filter(
        F.transform(F.split(message, delimiter), lambda p: strip(p)), lambda p: p.contains("=")
    )
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("key"),
            strip(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _: k != p["key"]),
            F.map_from_arrays(F.array(p["key"]), F.array(p["value"])),
        ),
    )


# ------------------------------------------------------------------ command lines
def command_line(text: Column) -> Column:
    """Lower-case command line without a ``cmd /s /c "…"`` or ``cmd /c "…"`` wrapper."""
    wrapped = java(r'^cmd(?:\.exe)?\s+(?:/s\s+)?/c\s+"(.+)"$')
    return non_empty(F.regexp_replace(F.lower(strip(text)), wrapped, "$1"))


def words(text: Column) -> Column:
    """Split on white space, no empty parts."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_args(args: Column) -> Column:
    return F.when(F.size(args) > 0, F.transform(args, lambda a: F.lower(strip(a))))


def quoted_args(text: Column) -> Column:
    """Quote-aware argument split.

    A quoted run belongs to the word it touches; an unbalanced quote falls back to a plain
    white-space split, as a shell-style splitter would.
    """
    balanced = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 0
    tokens = F.when(
        balanced, F.regexp_extract_all(text, F.lit(r"""("[^"]*"|[^\s"]+(?:"[^"]*")*[^\s"]*)"""), F.lit(1))
    ).otherwise(words(text))
    trimmed = F.transform(tokens, lambda t: F.trim(t, F.lit('"')))
    return F.when(balanced, F.filter(trimmed, lambda t: t != "")).otherwise(tokens)


_EXTENSIONS = "|".join(fv.EXECUTABLE_EXTENSIONS)


def split_command(text: Column) -> tuple[Column, Column]:
    """Executable and argument list of a command: quoted, known binary, then extension search."""
    raw = non_empty(strip(text))
    quoted = r"""^(["'])(.*?)\1\s*([\s\S]*)$"""
    first = F.regexp_extract(raw, r"^(\S+)\s*([\s\S]*)$", 1)
    first_rest = F.regexp_extract(raw, r"^(\S+)\s*([\s\S]*)$", 2)
    base = F.substring_index(basename(first), ".", 1)
    known = first.rlike(rf"(?i)\.(?:{_EXTENSIONS})$") | base.isin(*fv.BARE_BINARIES)
    search = rf"(?id)^(.*?\.(?:{_EXTENSIONS}))(?:\s+(.*))?$"
    is_quoted, is_search = raw.rlike(f"(?s){quoted}"), raw.rlike(search)
    executable = (
        F.when(is_quoted, F.regexp_extract(raw, f"(?s){quoted}", 2))
        .when(known, first)
        .when(is_search, F.regexp_extract(raw, search, 1))
        .otherwise(first)
    )
    rest = (
        F.when(is_quoted, F.regexp_extract(raw, f"(?s){quoted}", 3))
        .when(known, first_rest)
        .when(is_search, F.regexp_extract(raw, search, 2))
        .otherwise(first_rest)
    )
    args = words(rest)
    return (
        F.when(raw.isNotNull(), executable),
        F.when(raw.isNotNull() & (F.size(args) > 0), args),
    )


def execution_target(executable: Column, args: Column) -> Column:
    """What a task really runs: the executable, or an interpreter's first file argument."""
    base = F.regexp_extract(executable, r"([^\\/]*)$", 1)
    files = F.filter(
        F.coalesce(args, F.array().cast("array<string>")),
        lambda a: a.rlike(r"[\\/]") & F.regexp_extract(a, r"([^\\/]*)$", 1).contains("."),
    )
    return F.when(base.isin(*fv.INTERPRETERS), F.lower(F.get(files, F.lit(0)))).otherwise(
        executable
    )


def installer_activity(process: Column, command: Column, parent_command: Column) -> Column:
    """Web-stack installers start shells too; true where the command looks like one."""
    first_word = F.get(words(command), F.lit(0))
    wrapped = (
        matches(process, fv.CMD_WRAPPER)
        & matches(group(first_word, fv.FIRST_EXE), fv.XAMPP_TOOL)
        & matches(command, fv.XAMPP_PATH)
    )
    direct = matches(process, fv.XAMPP_TOOL) & matches(command, fv.XAMPP_PATH)
    return F.coalesce(command != "", F.lit(False)) & (
        matches(parent_command, fv.INSTALLER_PARENT)
        | direct
        | wrapped
        | matches(command, fv.BENIGN_PHP_PROBE)
    )


# ------------------------------------------------------------------ urls
def effective_url(original: Column, path: Column) -> Column:
    """The referer-like original unless empty or ``-``, else the path; lower case, never null."""
    usable = (original != "") & (original != "-")
    return F.lower(F.coalesce(F.when(usable, original), path, F.lit("")))


def _url_query(url: Column) -> Column:
    return F.regexp_extract(F.substring_index(url, "#", 1), r"(?s)\?(.*)$", 1)


def _url_path(url: Column) -> Column:
    body = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    no_scheme = F.regexp_replace(body, r"^[a-z][a-z0-9+.\-]*:", "")
    no_host = F.regexp_replace(no_scheme, r"^//[^/]*", "")
    return F.regexp_replace(no_host, r";[^/]*$", "")


def url_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))


def query_param(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded."""
    return url_decode(non_empty(F.regexp_extract(_url_query(url), rf"(?:^|&){name}=([^&]+)", 1)))


def _has_param(url: Column, names: tuple[str, ...]) -> Column:
    """Cheap test that comes before the extraction of single parameters."""
    return url.contains("?") & url.rlike(rf"[?&](?:{'|'.join(names)})=[^&]")


def _last_segment(text: Column) -> Column:
    return F.regexp_extract(text, r"([^/]*)/*$", 1)


def url_file_name(url: Column) -> Column:
    """File name in an include-style parameter, else the last path segment; it needs a dot."""
    def with_dot(name: Column) -> Column:
        return F.when(name.contains("."), name)

    candidates = [with_dot(_last_segment(query_param(url, p))) for p in fv.FILE_PARAMS]
    included = F.when(_has_param(url, fv.FILE_PARAMS), F.coalesce(*candidates))
    return F.coalesce(included, with_dot(_last_segment(_url_path(url))))


def url_command(url: Column) -> Column:
    """Command in a web-shell style parameter, by the priority of the parameter names."""
    values = F.coalesce(*[query_param(url, p) for p in fv.COMMAND_PARAMS])
    return F.when(_has_param(url, fv.COMMAND_PARAMS), values)


def body_command(body: Column) -> Column:
    """First form value holding both a command word and a shell metacharacter.

    Values are visited by the first appearance of their name, as a form parser groups them.
    """
    parts = F.filter(F.split(body, "&"), lambda p: p.rlike(r"(?s)^[^=]*=.+"))
    names = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    ordered = F.array_sort(
        F.transform(
            parts,
            lambda p, i: F.struct(
                F.array_position(names, F.substring_index(p, "=", 1)).alias("name_at"),
                i.alias("at"),
                strip(url_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))).alias("value"),
            ),
        )
    )
    hits = F.filter(
        ordered,
        lambda p: p["value"].rlike(java(fv.BODY_COMMAND))
        & p["value"].rlike(fv.BODY_METACHARACTER_CS),
    )
    return F.get(hits, F.lit(0))["value"]


def session_id(text: Column) -> Column:
    """Session id found in cookie text, by the priority of the known cookie names."""
    return F.coalesce(*[non_empty(F.regexp_extract(text, f"(?i){p}", 1)) for p in fv.SESSION_COOKIES])


# ------------------------------------------------------------------ Windows identifiers
def sid_from_bytes(numbers: Column) -> Column:
    """``S-r-a-…`` text of a raw security id given as an array of byte values."""
    # The members are read many times: inside a function over one element they have a name.
    return F.get(F.transform(F.array(numbers), _sid_text), F.lit(0))


def _sid_text(numbers: Column) -> Column:
    authority = F.aggregate(
        F.slice(numbers, 3, 6), F.lit(0).cast("bigint"), lambda acc, b: acc * 256 + b
    )
    count = F.get(numbers, F.lit(1))
    subs = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (
            F.get(numbers, 8 + i * 4).cast("bigint")
            + F.get(numbers, 9 + i * 4).cast("bigint") * 256
            + F.get(numbers, 10 + i * 4).cast("bigint") * 65536
            + F.get(numbers, 11 + i * 4).cast("bigint") * 16777216
        ).cast("string"),
    )
    return F.concat(
        F.lit("S-"),
        F.get(numbers, F.lit(0)).cast("string"),
        F.lit("-"),
        authority.cast("string"),
        F.lit("-"),
        F.array_join(subs, "-"),
    )


def xml_texts(xml: Column, *paths: tuple[str, ...]) -> Column:
    """Texts of nested elements in the order of their paths, found by local names so that namespaces do not matter.

    The document is parsed once for all of them: XPath joins the texts with a character that no XML can hold.
    """
    steps = ["//" + "/".join(f"*[local-name()=\"{p}\"]" for p in path) for path in paths]
    safe = F.when(strip(xml).startswith("<"), xml)
    joined = ', "\0", '.join(f"string({s})" for s in steps)
    return F.split(F.xpath_string(safe, F.lit(f"concat({joined})")), "\\x00")


def dns_answers(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: strip(p)), lambda p: p != "")
    return F.when(
        text != "",
        F.transform(parts, lambda p: F.struct(p.alias("data"), F.lit("A").alias("type"))),
    )


# ------------------------------------------------------------------ small helpers
def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), severity) - 1).cast("int")


def severity_label(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in fv.SEVERITIES]), rank)


def string_map(**entries: Column) -> Column:
    """Map of the non-null entries, values as text."""
    arrays = [(k, v.cast("string")) for k, v in entries.items()]
    full = F.map_from_arrays(
        F.array(*[F.lit(k) for k, _ in arrays]), F.array(*[v for _, v in arrays])
    )
    return F.map_filter(full, lambda _, v: v.isNotNull())


def once(column: Column) -> Column:
    """Keep the optimiser from copying an expensive expression into filters above it.

    Filters are not pushed through a projection that has a non-deterministic member, and
    reading the partition number makes this one formally so.  The value does not change.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so that reruns give the same rows."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def digest(text: Column) -> Column:
    """16 bytes that stand for a text, for steps that only compare many long ones."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


# ------------------------------------------------------------------ nested output
def pruned(value: Column, kind: T.DataType) -> Column:
    """The value without its empty members at any depth; null if nothing is left.

    Empty are nulls, empty texts, and structs, arrays and maps without a member that is left.  Zero and
    false stay, as do binary values and keys of maps.  The type does not change.
    """

    def unless_empty(made: Column, keep) -> Column:
        # A filter over one element names the value once, however deep it is nested.
        return F.get(F.filter(F.array(made), keep), F.lit(0))

    if isinstance(kind, T.StringType):
        return F.when(value != "", value)
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.lit(None).cast(kind)
        made = F.struct(*[pruned(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return unless_empty(made, lambda s: any_of([s.getField(f.name).isNotNull() for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        members = F.filter(F.transform(value, lambda e: pruned(e, kind.elementType)), lambda e: e.isNotNull())
        return unless_empty(members, lambda a: F.size(a) > 0)
    if isinstance(kind, T.MapType):
        entries = F.map_filter(F.transform_values(value, lambda _, v: pruned(v, kind.valueType)), lambda _, v: v.isNotNull())
        return unless_empty(entries, lambda m: F.size(m) > 0)
    return value


def pruned_json(value: Column, kind: T.DataType) -> Column:
    """JSON text of a struct without empty members; an empty object if nothing is left."""
    return F.coalesce(F.to_json(pruned(value, kind)), F.lit("{}"))
