"""Delimited files of contacts: encoding, delimiter, headers that may be missing or float, columns found by name or content.

The encoding is decided by Spark from all bytes, the rest on the driver from a file's first characters; the rows are read by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactdq.sources.workbook import SUFFIXES, workbook_rows

#: Encodings and delimiters in order of trial, and words that make a row a header.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = (";", ",", "\t", "|")
HEADER_WORDS = ("mail", "correo", "email", "tel", "cel", "cuit", "id", "denom", "nombre", "razon", "razón", "name", "titular")
MAIL_WORDS, PHONE_WORDS = ("mail", "correo", "email"), ("tel", "cel", "movil", "móvil", "fono", "whatsapp")
NUMBER_WORDS, SUBJECT_WORDS, NAME_WORDS = ("cuit", "cuil", "dni", "documento", "nro_doc"), ("denom", "nombre", "razon", "razón", "titular", "apellido"), ("denom", "nombre", "razon", "razón", "name", "titular")
KEY_WORDS = ("cuit", "dni", "cuil", "documento")


def detect_encoding(content: bytes) -> str:
    """The first encoding that decodes the whole content."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not content.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            content.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return ENCODINGS[-1]


#: Fixed: what cp1252 has for the bytes 80 to 9F, and the bytes among them it lacks.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
_NOT_CP1252 = "[\x81\x8d\x8f\x90\x9d]"


def file_encoding(spark: SparkSession, path: str, first: bytes) -> str:
    """As ``detect_encoding`` on all bytes of the file: Spark's text reader keeps the bytes of a line as they are, but for a mark of the byte order at the start."""
    lines = spark.read.text(path)
    tests = lines.agg(F.min(F.is_valid_utf8("value")), F.max(F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(_NOT_CP1252))).first()
    if tests[0] is not False:
        return "utf-8-sig" if first.startswith(b"\xef\xbb\xbf") else "utf-8"
    return "latin-1" if tests[1] else "cp1252"


def _as_cp1252(latin: Column) -> Column:
    return F.translate(latin, _C1, _CP1252)


def detect_delimiter(text: str) -> str:
    """The delimiter that splits the first lines into the same number of cells, else the most frequent one, else a comma."""
    lines = [x for x in text[:8192].splitlines() if x.strip()][:20]
    even = [d for d in DELIMITERS if lines and len({x.count(d) for x in lines}) == 1 and d in lines[0]]
    if even:
        return max(even, key=lambda d: lines[0].count(d))
    found = Counter(c for c in text[:8192] if c in DELIMITERS)
    return found.most_common(1)[0][0] if found else ","


def is_header(cells: list[str]) -> bool:
    """A cell without an at sign, and a word that headers have."""
    return any("@" not in c for c in cells) and any(w in c.lower() for c in cells for w in HEADER_WORDS)


def head(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, wherever Spark can read it: whole lines from the start, as many as it takes, ``n`` bytes at most."""
    lines = spark.read.text(path).select(F.substring(F.col("value").cast("binary"), 1, n).alias("b")).limit(max(20, n // 64)).collect()
    return b"\n".join(bytes(r["b"]) for r in lines)[:n]


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell can reach over a line end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(spark.read.text(path).agg(F.max(quotes % 2)).first()[0])


def _joined(odd_at_start: dict[int, int]):
    """Lines of a block, in order, as records; ``odd_at_start`` has the blocks that start within quotes.

    ``kind`` is 0 for a whole record, 1 for the end of one that an earlier block began, 2 for the start of one that goes on in the next, 3 for what is neither.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, inside, began = [], None, None, False
        for batch in batches:
            out = ([], [], [])
            for n, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if inside is None:
                    inside, began = n >> 33 in odd_at_start, n >> 33 not in odd_at_start
                if not held:
                    first = n
                held.append(line)
                inside ^= line.count(b'"') % 2 == 1
                if not inside:
                    for column, value in zip(out, (first, b"\n".join(held).removesuffix(b"\r"), 0 if began else 1)):
                        column.append(value)
                    held, began = [], True
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["_n", "value", "kind"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([b"\n".join(held)], pa.binary()), pa.array([2 if began else 3], pa.int32())], ["_n", "value", "kind"])

    return join


def records(spark: SparkSession, path: str) -> DataFrame:
    """``_n, value`` (bytes): the records of a delimited file in order, cells between quotes reaching over line ends; each task reads its block.

    A block starts within quotes if the blocks before it hold an odd number of them: one number for each block comes to the driver. What reaches over the
    end of a block is put together from the parts that the blocks give, two for each at most.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("_n"), F.col("value").cast("binary").alias("value"))
    quotes = F.length(F.decode("value", "ISO-8859-1")) - F.length(F.translate(F.decode("value", "ISO-8859-1"), '"', ""))
    odd, inside = {}, 0
    for row in lines.groupBy(F.shiftright("_n", 33).alias("block")).agg((F.sum(quotes) % 2).alias("odd")).orderBy("block").collect():
        if inside:
            odd[row["block"]] = 1
        inside ^= row["odd"]
    parts = lines.mapInArrow(_joined(odd), "_n long, value binary, kind int")
    chains = parts.filter("kind > 0").withColumn("chain", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(Window.orderBy("_n")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.hex("value").alias("value")))), lambda x: x["value"])
    whole = chains.groupBy("chain").agg(F.min("_n").alias("_n"), F.unhex(F.array_join(pieces, "0A")).alias("value"))
    return parts.filter("kind = 0").select("_n", "value").unionByName(whole.select("_n", F.expr("CASE WHEN endswith(value, X'0D') THEN left(value, length(value) - 1) ELSE value END AS value")))


def _decoded(value: Column, encoding: str) -> Column:
    """Bytes as text, without a mark of the byte order."""
    text = F.decode(value, "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1")
    return F.regexp_replace(_as_cp1252(text) if encoding == "cp1252" else text, "^\ufeff", "")


def _columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with ``_c`` as columns; short ones padded, long ones cut, rows without any value left out."""
    return rows.filter(F.exists("_c", lambda x: F.trim(x) != "")).select(*[F.coalesce(F.get("_c", i), F.lit("")).alias(name) for i, name in enumerate(names)])


def _read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None, str]:
    rows = workbook_rows(spark, path)
    first = rows.orderBy("_n").limit(1).first()
    cells = [c.strip() for c in first["_c"]] if first else []
    width = rows.agg(F.max(F.size("_c"))).first()[0] or 0
    header = cells if is_header(cells) else None
    names = [*(header or []), *[f"c{i}" for i in range(len(header or []), width)]]
    return _columns(rows.filter(F.col("_n") > (0 if header else -1)), names), header, ","


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str] | None, str]:
    """(rows, header or None, delimiter) of a delimited file or a workbook. Without a header the columns are c0, c1, ...

    A file is read in as many parts as it has blocks, also where quoted cells reach over line ends.
    """
    if path.lower().endswith(SUFFIXES):
        return _read_workbook(spark, path)
    raw = head(spark, path, 65536)
    encoding = file_encoding(spark, path, raw)
    text = raw.decode(encoding, "replace").removeprefix("\ufeff")
    delimiter = detect_delimiter(text[:4096])
    first = next((x for x in text.splitlines() if x.strip()), "").split(delimiter)
    header = [c.strip().strip('"') for c in first] if is_header(first) else None
    if _spans_lines(spark, path):
        cells = records(spark, path).select("_n", _cells(_decoded(F.col("value"), encoding), delimiter).alias("_c")).filter(F.exists("_c", lambda x: x != ""))
        top = cells.orderBy("_n").limit(1).first()
        names = header or [f"c{i}" for i in range(len(top["_c"]) if top else 0)]
        below = cells.filter(F.col("_n") > top["_n"]) if header and top else cells
        return below.select(*[F.nullif(F.get("_c", i), F.lit("")).alias(n) for i, n in enumerate(names)]), header, delimiter
    spark_encoding = "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1"
    rows = spark.read.options(sep=delimiter, header=header is not None, encoding=spark_encoding, quote='"', escape='"', mode="PERMISSIVE").csv(path)
    rows = rows.toDF(*(header or [f"c{i}" for i in range(len(rows.columns))]))
    if encoding == "cp1252":
        names = rows.columns
        inner = rows.toDF(*[f"_{i}" for i in range(len(names))])
        rows = inner.select(*[_as_cp1252(F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])
    return rows, header, delimiter


def _cells(line: Column, delimiter: str) -> Column:
    """The cells of a line; a delimiter between quotes parts nothing, doubled quotes are one."""
    outside = F.split(F.concat(line, F.lit(delimiter)), f'\\Q{delimiter}\\E(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(F.slice(outside, F.lit(1), F.size(outside) - 1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'(?s)^"(.*)"$', "$1"), '""', '"'))


def read_contacts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Rows of a delimited file or a workbook below the first one that has ``column`` as a cell, whatever its case; blank rows are dropped, short ones padded, long ones cut."""
    cells = workbook_rows(spark, path) if path.lower().endswith(SUFFIXES) else _delimited_rows(spark, path)
    found = cells.filter(F.exists("_c", lambda x: F.lower(F.trim(x)) == column.lower())).orderBy("_n").limit(1).first()
    if found is None:
        raise ValueError(f"no header with {column!r} in {path}")
    return _columns(cells.filter(F.col("_n") > found["_n"]), [c.strip() for c in found["_c"]])


def _delimited_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = head(spark, path, 65536)
    encoding = file_encoding(spark, path, raw)
    delimiter = detect_delimiter(raw.decode(encoding, "replace")[:8192])
    if _spans_lines(spark, path):
        lines = records(spark, path)
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_n"), F.col("value").cast("binary").alias("value"))
    return lines.select("_n", _cells(_decoded(F.col("value"), encoding), delimiter).alias("_c"))


def _named(header: list[str] | None, test) -> list[int]:
    return [i for i, name in enumerate(header or []) if test(str(name).lower())]


def _has(words: tuple[str, ...]):
    return lambda name: any(w in name for w in words)


def _most_digits(first: list[str]) -> int | None:
    """The first of the cells with most digits; there may be none in it."""
    return max(range(len(first)), key=lambda i: sum("0" <= ch <= "9" for ch in str(first[i] or ""))) if first else None


def process_columns(header: list[str] | None, first: list[str], process: str) -> tuple[int | None, int]:
    """(identifier, datum) of a file for a process: by the names in the header, else by the first row, else by place.

    For numbers with a name the pair is (number, name), for name pairs (left, right); for mails and phones the identifier may be missing.
    """
    if process in ("cuit", "cuitificacion"):
        number, name = _named(header, _has(NUMBER_WORDS)), _named(header, _has(SUBJECT_WORDS))
        at = number[0] if number else _most_digits(first) or 0
        return at, name[0] if name else int(at != 1)
    if process in ("denominacion", "comparacion"):
        both = _named(header, _has(NAME_WORDS))
        return (both[0], both[1]) if len(both) > 1 else (0, 1)
    mail = process in ("mails", "osint")
    datum = _named(header, lambda n: _has(MAIL_WORDS if mail else PHONE_WORDS)(n) and "id" not in n[:3])
    key = _named(header, lambda n: "cuit" in n or n.startswith("id") or "_id" in n or "dni" in n)
    by_content = next((i for i, c in enumerate(first) if "@" in str(c or "")), None) if mail else _most_digits(first)
    return key[0] if key else None, datum[0] if datum else by_content or 0


def normalisation_columns(header: list[str] | None, first: list[str], media: tuple[str, ...] = ("mails", "telefonos")) -> tuple[int, list[int], list[int]]:
    """(key, media columns asked for, the rest): the key is the first identifying column, else the first one; media are found by name, else by the first row."""
    keys = _named(header, lambda n: _has(KEY_WORDS)(n) or n.startswith("id") or "_id" in n)
    key = keys[0] if keys else 0
    mails = [i for i in _named(header, _has(MAIL_WORDS)) if i not in keys[:1]]
    phones = [i for i in _named(header, _has((*PHONE_WORDS, "wsp"))) if i not in mails and i not in keys[:1]]
    if not mails and not phones:
        others = [(i, str(c or "")) for i, c in enumerate(first) if i != key]
        mails = [i for i, c in others if "@" in c]
        phones = [i for i, c in others if "@" not in c and sum("0" <= ch <= "9" for ch in c) >= 6]
    found = sorted({*(mails if "mails" in media else ()), *(phones if "telefonos" in media else ())})
    return key, found, [i for i in range(len(header or first)) if i != key and i not in found]


def mail_columns(header: list[str]) -> tuple[str | None, str | None]:
    """(id column, mail column) of an older mail file: a name with MAIL, preferably without ID."""
    mails = [n for n in header if "MAIL" in n.upper()]
    return next((n for n in header if "ID" in n.upper()), None), next((n for n in mails if "ID" not in n.upper()), mails[0] if mails else None)


def read_list(spark: SparkSession, path: str, default: tuple[str, ...] | dict[str, str]):
    """A reference list: a value or ``a = b`` a line, lower-cased, lines that start with ``#`` left out; the default where the file is missing or empty."""
    from pyspark.errors import AnalysisException

    try:
        lines = [r[0].strip() for r in spark.read.text(path).collect()]
    except AnalysisException:
        return default
    lines = [x.lower() for x in lines if x and not x.startswith("#")]
    if isinstance(default, dict):
        pairs = (tuple(p.strip() for p in x.split("=", 1)) for x in lines if "=" in x)
        return {a: b for a, b in pairs if a and b} or default
    return tuple(dict.fromkeys(lines)) or default


def write_defaults(spark: SparkSession, folder: str, defaults: dict[str, tuple[str, ...] | dict[str, str]]) -> list[str]:
    """Put the default lists into a folder, a file for each name, where there is none yet, for clients to edit; the names written."""
    written = []
    for name, default in defaults.items():
        path = f"{folder.rstrip('/')}/{name}.txt"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        lines = [f"{a} = {b}" for a, b in default.items()] if isinstance(default, dict) else list(default)
        spark.createDataFrame([(x,) for x in [f"# {name}", *lines]], "value string").coalesce(1).write.text(path)
        written.append(name)
    return written


def read_registry(spark: SparkSession, path: str, id_column: str, name_column: str) -> DataFrame:
    """ID_BASE and DENOM of a registry file; rows without a name are dropped, a missing id becomes the number of the row, from 1."""
    from contactdq.operators.profile import numbered

    rows, _, _ = read_table(spark, path)
    named = numbered(rows, "_n").filter(F.trim(F.coalesce(F.col(name_column), F.lit(""))) != "")
    return named.select(F.coalesce(F.nullif(F.trim(F.col(id_column)), F.lit("")), F.col("_n").cast("string")).alias("ID_BASE"), F.col(name_column).alias("DENOM"))


def read_mail_file(spark: SparkSession, path: str) -> tuple[DataFrame, str | None, str]:
    """(rows, id column, mail column) of an older mail file: a semicolon parts its cells if the first 2048 characters hold one, else a comma; without a column of mails it is an error."""
    sep = ";" if b";" in head(spark, path, 2048) else ","
    rows = spark.read.options(sep=sep, header=True, encoding="UTF-8", quote='"', escape='"').csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    key, mail = mail_columns(rows.columns)
    if mail is None:
        raise ValueError(f"no column of mails in {path}: {', '.join(rows.columns)}")
    return rows, key, mail
