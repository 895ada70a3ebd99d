"""Scalar functions of the document IR as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and patterns that detectors look for.
DANGEROUS_XLM = (
    "EXEC", "CALL", "REGISTER", "RUN", "FOPEN", "FWRITE", "FWRITELN", "FREAD", "FREADLN", "FCLOSE", "URLDOWNLOADTOFILE", "ALERT", "HALT",
    "FORMULA", "FORMULA.FILL", "SET.VALUE", "SET.NAME",
)
AUTO_EXEC = (
    "AutoOpen", "AutoClose", "AutoNew", "AutoExec", "AutoExit", "Document_Open", "Document_Close", "Document_New", "Auto_Open", "Auto_Close",
    "Workbook_Open", "Workbook_BeforeClose", "Workbook_Activate",
)
SUSPICIOUS_CALLS = {
    "Shell": "ShellExecution", "WScript.Shell": "ShellExecution", "ShellExecute": "ShellExecution", "CreateObject": "ProcessManipulation",
    "GetObject": "ProcessManipulation", "FileSystemObject": "FileSystem", "Scripting.FileSystemObject": "FileSystem", "XMLHTTP": "Network",
    "WinHTTP": "Network", "MSXML2": "Network", "InternetExplorer": "Network", "PowerShell": "PowerShell", "Wscript": "ShellExecution",
    "RegRead": "Registry", "RegWrite": "Registry", "RegDelete": "Registry", "Declare Function": "WindowsApi", "Declare Sub": "WindowsApi",
    "CallByName": "ProcessManipulation", "Chr": "Obfuscation", "ChrW": "Obfuscation", "Base64": "Obfuscation", "StrReverse": "Obfuscation",
    "Environ": "ShellExecution",
}
SUSPICIOUS_FUNCTIONS = ("WEBSERVICE", "HYPERLINK", "URL", "EXEC", "CALL", "SHELL", "DDE", "DDEAUTO")
SUSPICIOUS_TLDS = ("ru", "cn", "tk", "ml", "ga", "cf")
SUSPICIOUS_DOMAINS = ("pastebin.com", "bit.ly", "tinyurl.com", "raw.githubusercontent.com", "ngrok.io", "serveo.net")
MEDIA_TYPES = {
    "Image": ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp"), "Audio": ("mp3", "wav", "m4a", "aac", "ogg"),
    "Video": ("mp4", "mov", "avi", "mkv", "webm"),
}
MEDIA_CLASSES = {
    "png": ("image", "image/png"), "jpg": ("image", "image/jpeg"), "jpeg": ("image", "image/jpeg"), "gif": ("image", "image/gif"),
    "bmp": ("image", "image/bmp"), "tif": ("image", "image/tiff"), "tiff": ("image", "image/tiff"), "webp": ("image", "image/webp"),
    "wav": ("audio", "audio/wav"), "mp3": ("audio", "audio/mpeg"), "mp4": ("video", "video/mp4"),
}
OFFICE_EXTENSIONS = ("docx", "docm", "xlsx", "xlsm", "pptx", "pptm")
SEVERITIES = ("None", "Low", "Medium", "High", "Critical")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def abbreviate(text: Column, n: int = 80) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def column_letter(index: Column) -> Column:
    """0-based column index to letters, up to three of them."""
    letter = lambda i: F.chr(F.lit(65) + i)
    one, two = index, index - 26
    three = index - 702
    return (
        F.when(index < 26, letter(one))
        .when(index < 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.pmod(F.floor(three / 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    )


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns ticks since 1601 to a UTC timestamp."""
    return F.timestamp_micros(F.floor(ticks.cast("decimal(20,0)") / 10).cast("long") - F.lit(11_644_473_600_000_000))


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def format_float(x: Column) -> Column:
    return F.when(x == F.round(x), F.format_string("%.0f", x)).otherwise(F.format_string("%.6f", x))


def percent_decoded(url: Column) -> Column:
    """Lower-cased, with each %XX as the character of that code."""
    parts = F.split(F.lower(url), "%")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(p.rlike("^[0-9a-f]{2}"), F.concat(F.lower(F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("int"))), p.substr(F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "")


def url_host(url: Column) -> Column:
    """Lower-case host: no known scheme, user part (up to the last @), path, query, fragment, brackets, port or trailing dots."""
    rest = F.regexp_replace(F.lower(url), "^(https?|ftp|smb|sftp|file|ldaps?)://", "")
    rest = F.regexp_replace(rest, "(?s)^.*@", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?s)[/?#\\].*$", ""), r"\.+$", "")
    host = F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(rest, "(?s):.*$", ""))
    return F.regexp_replace(host, r"\.+$", "")


def is_ip_address(host: Column) -> Column:
    """A dotted quad of numbers to 255, an IPv6 literal, or a 0x number of 32 bits."""
    octet, group = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})", "[0-9a-fA-F]{1,4}"
    some = f"({group}(:{group})*)?"
    short = host.rlike(f"^{some}::{some}$") & (F.size(F.regexp_extract_all(host, F.lit(group), F.lit(0))) <= 7)
    return host.rlike(rf"^({octet}\.){{3}}{octet}$") | host.rlike(f"^({group}:){{7}}{group}$") | short | host.rlike("^0[xX]0*[0-9a-fA-F]{1,8}$")


def host_matches(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def is_remote(target: Column) -> Column:
    return F.lower(target).rlike(r"^((https?|ftp|smb|sftp|ldaps?|file)://|\\\\|//)")


def is_suspicious_url(url: Column) -> Column:
    """By the host of the decoded URL: a listed top level, an IP address or a listed domain; or a UNC path."""
    decoded = percent_decoded(url)
    host = url_host(decoded)
    listed = reduce(lambda a, b: a | b, (host_matches(host, d) for d in SUSPICIOUS_DOMAINS))
    return host.rlike(r"\.(" + "|".join(SUSPICIOUS_TLDS) + ")$") | is_ip_address(host) | listed | decoded.rlike(r"^(\\\\|//)")


def is_external_target(target: Column) -> Column:
    """A target of a link that leaves the document: any scheme with ``://``, or one of four without."""
    return target.contains("://") | F.lower(target).rlike("^(file|smb|ftp|mailto):")


def looks_external(target: Column) -> Column:
    """A relationship target that leaves the package: ``//``, a UNC path, or a scheme before the first colon."""
    return target.rlike(r"^(//|\\\\|[A-Za-z][A-Za-z0-9+.-]*:)")


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""((?:(?:https?|file|ftp)://|mailto:)[^\s"')>]+)"""), 1)


def strip_string_literals(formula: Column) -> Column:
    """Quoted runs, an unclosed one included, as one blank."""
    return F.regexp_replace(formula, '"(?:[^"]|"")*("|$)', " ")


def is_suspicious_formula(formula: Column) -> Column:
    names = "|".join(SUSPICIOUS_FUNCTIONS)
    return strip_string_literals(F.upper(formula)).rlike(rf"(^|[^A-Z0-9_])({names})\(")


def formula_functions(formula: Column) -> Column:
    return F.transform(F.regexp_extract_all(formula, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), 1), F.upper)


def dangerous_xlm(formula: Column) -> Column:
    """All dangerous names that the formula calls, in the order of the list."""
    name = lambda n: n.replace(".", r"\.")
    hits = [F.when(F.upper(formula).rlike(rf"(^|[=(,;\s+*/&-]){name(n)}($|[(,;)\s.!])"), F.lit(n)) for n in DANGEROUS_XLM]
    return F.array_compact(F.array(*hits))


def is_comment(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*('|rem($|[\s:]))")


def vba_procedure(line: Column) -> Column:
    """The name of the procedure that a line declares, else the empty text."""
    return F.regexp_extract(line, r"(?i)^\s*(?:(?:private|public|friend|static)\s+)*(?:sub|function)\s+([^\s(]+)", 1)


def suspicious_calls(line: Column) -> Column:
    """(name, category) of each listed call in a line that is no comment, between identifier boundaries."""
    hit = lambda n: line.rlike(rf"(?i)(?<![A-Za-z0-9_]){n.replace('.', chr(92) + '.')}(?![A-Za-z0-9_])")
    found = [F.when(hit(n), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for n, c in SUSPICIOUS_CALLS.items()]
    return F.filter(F.array_compact(F.array(*found)), lambda _: ~is_comment(line))


def is_auto_exec(name: Column) -> Column:
    return F.lower(name).isin(*[n.lower() for n in AUTO_EXEC])


def quoted_parts(text: Column) -> Column:
    """The texts between double quotes, two quotes in a row being one inside; an unclosed one goes to the end, unless it
    is empty."""
    parts = F.regexp_extract_all(text, F.lit(r'"((?:[^"]|"")*)(?:"|$)'), 1)
    plain = F.transform(parts, lambda p: F.replace(p, F.lit('""'), F.lit('"')))
    unclosed = F.length(F.regexp_replace(text, '[^"]', "")) % 2 == 1
    return F.when(unclosed & (F.element_at(plain, -1) == ""), F.slice(plain, 1, F.size(plain) - 1)).otherwise(plain)


def dde(instruction: Column) -> tuple[Column, Column, Column, Column]:
    """(field type, application, topic, item) of a DDE or DDEAUTO instruction with quoted parts. Without an
    application it is "unknown" and the others are null, as empty ones are."""
    kind = F.upper(F.regexp_extract(instruction, r"(?i)^\s*(DDEAUTO|DDE)(?=\s|$)", 1))
    parts = quoted_parts(instruction)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i - 1)), F.lit(""))
    none = part(1) == ""
    more = lambda i: F.when(~none & (part(i) != ""), part(i))
    return kind, F.when(none, F.lit("unknown")).otherwise(part(1)), more(2), more(3)


def normalized_dde(kind: Column, application: Column, topic: Column, item: Column) -> Column:
    shown = lambda c, none: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(none)).otherwise(c)
    return F.concat(kind, F.lit(" app="), shown(application, "<unknown>"), F.lit(" topic="), F.coalesce(topic, F.lit("<none>")), F.lit(" item="), F.coalesce(item, F.lit("<none>")))


def severity_rank(label: Column) -> Column:
    """0 for unknown labels."""
    return reduce(lambda c, s: c.when(label == s, F.lit(SEVERITIES.index(s))), SEVERITIES[1:], F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))


def severity_label(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank + 1)


def looks_like_text(data: Column) -> Column:
    """Whether a payload is not empty and its first 256 bytes are printable ASCII or white space."""
    return F.hex(F.substring(data, 1, 256)).rlike("^(09|0A|0C|0D|[2-6][0-9A-F]|7[0-9A-E])+$")


def payload_class(data: Column, name: Column | None = None) -> Column:
    """Class of a payload by its first bytes, of a ZIP by its file name too."""
    head = F.hex(F.substring(data, 1, 8))
    office = F.lit(False) if name is None else F.coalesce(F.lower(name).rlike(r"\.(" + "|".join(OFFICE_EXTENSIONS) + ")$"), F.lit(False))
    return (
        F.when(head.startswith("4D5A"), "pe").when(head.startswith("D0CF11E0"), "office").when(head.startswith("504B0304") & office, "office")
        .when(head.startswith("504B0304"), "zip").when(head.startswith("255044462D"), "pdf").when(looks_like_text(data), "script").otherwise("unknown")
    )


def extension(path: Column) -> Column:
    """What follows the last dot, the whole path without one, in lower case."""
    return F.lower(F.substring_index(path, ".", -1))


def media_type(path: Column) -> Column:
    chosen = F.when(F.lit(False), "")
    for kind, names in MEDIA_TYPES.items():
        chosen = chosen.when(extension(path).isin(*names), kind)
    return chosen.otherwise("Other")


def media_class(path: Column, data: Column) -> Column:
    """By the extension, else by the payload."""
    names = {}
    for name, (kind, _) in MEDIA_CLASSES.items():
        names.setdefault(kind, []).append(name)
    by_name = F.when(F.lit(False), "")
    for kind, own in names.items():
        by_name = by_name.when(F.lower(path).rlike(r"\.(" + "|".join(own) + ")$"), kind)
    return by_name.otherwise(payload_class(data, path))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def logical_root(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def decoded_hex(text: Column) -> Column:
    """The bytes of a text of hex digits, null for an odd number of them or any other character."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def cfb_entry_class(path: Column, entry_type: Column) -> Column:
    """Class of a compound-file entry by its type and path."""
    up = F.upper(path)
    storage = F.when((up == "OBJECTPOOL") | up.startswith("OBJECTPOOL/"), "embedded-object-storage").when((up == "VBA") | up.endswith("/VBA"), "vba-storage").otherwise("storage")
    stream = (
        F.when(up == "WORDDOCUMENT", "word-main-stream").when(up.isin("WORKBOOK", "BOOK"), "excel-main-stream")
        .when(up == "POWERPOINT DOCUMENT", "powerpoint-main-stream").when((up == "PROJECT") | up.endswith("/PROJECT"), "vba-project-metadata")
        .when(up.contains("/VBA/") | up.startswith("VBA/"), "vba-module-stream").when(up.endswith("OLE10NATIVE"), "ole-native-payload")
        .when((up == "PACKAGE") | up.endswith("/PACKAGE"), "package-payload").when(up.endswith("/CONTENTS"), "embedded-contents").otherwise("stream")
    )
    return F.when(entry_type == "root-storage", "root-storage").when(entry_type == "storage", storage).otherwise(stream)


def artifact_kind(path: Column, format: str) -> Column:
    """What a package part or stream is extracted as, null if it is not: by path alone."""
    if format == "ooxml":
        inside = lambda folder: path.rlike(f"^(word|xl|ppt)/{folder}/")
        return F.when(inside("embeddings") & path.rlike(r"\.(bin|ole)$"), "OleObject").when(inside("media"), "MediaAsset").when(inside("activeX") & path.rlike(r"\.(bin|dat)$"), "ActiveXControl")
    if format == "odf":
        return F.when(path.startswith("ObjectReplacements/") | (path.startswith("Object ") & ~path.endswith("/")), "OleObject").when(path.startswith("Pictures/"), "MediaAsset")
    if format == "hwpx":
        return F.when(path.startswith("BinData/"), "MediaAsset")
    up = F.upper(path)
    return F.when(up.contains("OBJECTPOOL/") | up.startswith("BINDATA/") | up.endswith("OLE10NATIVE") | (up == "PACKAGE") | up.endswith("/PACKAGE") | up.endswith("/CONTENTS"), "OleObject")


def node_id(text: Column) -> Column:
    """``node_<hex>`` or a decimal number, null if it is neither."""
    digits = F.regexp_extract(text, "^node_([0-9A-Fa-f]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long")).when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long"))


def within_sheet(row: Column, column: Column) -> Column:
    """Whether a 0-based cell lies in a worksheet's 1,048,576 rows and 16,384 columns."""
    return (row >= 0) & (row < 1_048_576) & (column >= 0) & (column < 16_384)


def quoted_strings(text: Column) -> Column:
    """Texts between single or double quotes that are not empty; an unclosed one goes to the end."""
    found = F.regexp_extract_all(text, F.lit(r"""("[^"]*(?:"|\z)|'[^']*(?:'|\z))"""), 1)
    bare = F.transform(found, lambda q: F.when(q.startswith('"'), F.replace(q, F.lit('"'), F.lit(""))).otherwise(F.replace(q, F.lit("'"), F.lit(""))))
    return F.filter(bare, lambda q: q != "")


def cell_ref(ref: Column) -> tuple[Column, Column]:
    """0-based (row, column) of a reference such as ``$B$7``, null if it is none."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$"
    letters, digits = F.upper(F.regexp_extract(ref, pattern, 1)), F.regexp_extract(ref, pattern, 2)
    index = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1
    row = F.try_to_number(digits, F.lit("9999999")).cast("long") - 1
    valid = (letters != "") & (row >= 0)
    return F.when(valid, row), F.when(valid, index)


def length_emu(text: Column) -> Column:
    """A length with a unit (cm, mm, in, pt, pc, px; none is px) in English metric units, null if it is none."""
    pattern = r"^\s*(-?[0-9.]+)\s*(cm|mm|in|pt|pc|px|)\s*$"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "cm", 360_000).when(unit == "mm", 36_000).when(unit == "in", 914_400).when(unit == "pt", 12_700).when(unit == "pc", 152_400).otherwise(9_525)
    return number * factor
