"""Secret scans with multipart credential linking.

Base kinds are single patterns. Weak parts (account identifiers, random-looking strings, endpoints) say nothing alone;
they are reported only where complementary parts stand within one scope of each other. A scope lies within one text, so the
interval join of a text's parts is done in its row: parts in order of their places are cut into runs, each run
keeps the identities and secrets within ``scope`` code points of it, and each part looks among these alone. Nothing is shuffled, and texts are read once.

Places are code points, ends exclusive. They come from the gaps between matches (``split``) and the matches themselves.

Edge cases: null and empty texts have no spans. Repeated rows and null ids get the same result each, and of parts at one place all
count. A very long text is searched whole, by patterns that read no run of characters twice; runs have the square root of its parts, so it costs no pairs of all parts. An empty table gives an empty
result. Columns other than the id and the text are ignored, except in ``redact``, which keeps them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.llm.common import whole_row

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")

#: Weak parts: identifiers by name, long strings with letters and digits, addresses.
IDENT = r"""(?i:client|user|account|tenant|access|login)(?i:[_ -]?(?:id|name|key))?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: An address starts at the first letter of a run of scheme characters. The run is read once, from its start, and given up as a whole; digits and
#: signs before the first letter belong to the match and not to the span.
ENDPOINT = r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+"""
BEFORE_ENDPOINT = r"\A[0-9+.-]*"

SPAN = "array<struct<start:int,end:int,kind:int>>"
LINK = "array<struct<start:int,end:int,kind:int,identity:int,secret:int>>"


def _spans(text: str, pattern: str, kind: str, least: int = 0, before: str | None = None) -> str:
    """SQL for the spans of a pattern in a text column; with ``least``, group 1 must have that many characters; what ``before`` matches is left out."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    skip = f"length(regexp_extract(x.hit, '{before.replace(chr(92), 2 * chr(92))}', 0))" if before else "0"
    ok = f"length(regexp_extract(x.hit, '{p}', 1)) >= {least}" if least else "true"
    return f"""CASE WHEN {text} RLIKE '{p}' THEN aggregate(
        arrays_zip(slice(split({text}, '{p}', -1), 1, size(split({text}, '{p}', -1)) - 1) AS gap, regexp_extract_all({text}, '{p}', 0) AS hit),
        named_struct('at', 0, 'out', cast(array() AS {SPAN})),
        (a, x) -> named_struct('at', a.at + length(x.gap) + length(x.hit),
          'out', CASE WHEN {ok} THEN array_append(a.out, named_struct('start', a.at + length(x.gap) + {skip}, 'end', a.at + length(x.gap) + length(x.hit), 'kind', {KINDS.index(kind)})) ELSE a.out END),
        a -> a.out) ELSE cast(array() AS {SPAN}) END""".replace(" AS gap", "").replace(" AS hit", "").replace("x.gap", "x['0']").replace("x.hit", "x['1']")


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["end"] - b["end"])


def _of(kinds: tuple[str, ...], spans: str) -> str:
    """SQL for the places where parts of some kinds start."""
    numbers = ", ".join(str(KINDS.index(k)) for k in kinds)
    return f"transform(filter({spans}, x -> x.kind IN ({numbers})), x -> x.start)"


def linked_parts(spans: str, scope: int = 200) -> str:
    """SQL for those of an array of spans (in order of their places) that are weak and have their complements in scope.

    An identifier needs a secret, a weak secret needs an identity, an endpoint needs both. ``identity`` and ``secret`` are the places of the
    nearest ones, the earlier of two that are as near; null for a kind that the part does not need.
    """
    step = f"greatest(8, int(ceil(sqrt(size({spans})))))"
    runs = f"transform(sequence(0, size({spans}) - 1, {step}), a -> struct(slice({spans}, a + 1, {step}) AS run))"
    near = lambda c: f"filter({_of(c, spans)}, p -> p BETWEEN r.run[0].start - {scope} AND element_at(r.run, -1).start + {scope})"
    held = f"transform({runs}, r -> struct(r.run AS run, {near(('ident', 'access'))} AS identities, {near(('weak', 'assign', 'hex'))} AS secrets))"
    nearest = lambda c: f"array_min(transform(filter(h.{c}, p -> abs(p - x.start) <= {scope}), p -> struct(abs(p - x.start) AS d, p AS p))).p"
    ident, weak, endpoint = (KINDS.index(k) for k in ("ident", "weak", "endpoint"))
    told = f"""flatten(transform({held}, h -> transform(filter(h.run, x -> x.kind >= {ident}), x -> struct(x.start AS start, x.end AS end, x.kind AS kind,
        CASE WHEN x.kind <> {ident} THEN {nearest("identities")} END AS identity, CASE WHEN x.kind <> {weak} THEN {nearest("secrets")} END AS secret))))"""
    chosen = f"filter({told}, x -> (x.kind = {ident} OR x.identity IS NOT NULL) AND (x.kind = {weak} OR x.secret IS NOT NULL))"
    return f"CASE WHEN exists({spans}, x -> x.kind >= {ident}) THEN {chosen} ELSE cast(array() AS {LINK}) END"


def scan(docs: DataFrame, text_col: str = "text", scope: int = 200) -> DataFrame:
    """For every row of ``docs``: ``row`` (all its columns), ``text`` (null as empty), ``base`` (spans of the base kinds by start, then kind) and ``links`` (linked weak parts)."""
    found = docs.select(whole_row(docs, "row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    base = F.concat(F.expr(_spans("text", ASSIGN, "assign", 6)), F.expr(_spans("text", ACCESS, "access")), F.expr(_spans("text", HEX, "hex")))
    found = found.withColumns({"base": F.array_sort(base, _by_place), "idents": F.expr(_spans("text", IDENT, "ident", 4))})
    # Other weak parts are looked for only where an identity stands: without one they cannot be linked.
    access = F.exists("base", lambda x: x["kind"] == KINDS.index("access"))
    weak = F.when(access | (F.size("idents") > 0), F.concat("idents", F.expr(_spans("text", WEAK, "weak")), F.expr(_spans("text", ENDPOINT, "endpoint", before=BEFORE_ENDPOINT))))
    found = found.withColumn("parts", F.array_sort(F.concat("base", F.coalesce(weak, F.array().cast(SPAN))), _by_place))
    return found.withColumn("links", F.expr(linked_parts("parts", scope))).drop("idents", "parts")


def _listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans, _by_place), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _plain(links: str) -> Column:
    return F.expr(f"transform({links}, x -> struct(x.start AS start, x.end AS end, x.kind AS kind))").cast(SPAN)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans, all spans, and the linked ones alone."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", scope).select(
        "row.doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", _plain("links"))).alias("spans"), _listed(_plain("links")).alias("linked_spans")
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by a mark; the length column follows. Other texts stay as they are, nulls included."""
    found = scan(docs, text_col, scope).withColumn("spans", F.array_sort(F.concat("base", _plain("links")), _by_place))
    done = F.expr(
        f"""CASE WHEN size(spans) > 0 THEN aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, x) -> CASE WHEN x.start >= a.at THEN named_struct('at', x.end, 'out', concat(a.out, substring(text, a.at + 1, x.start - a.at), '{mark}'))
                       ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END,
        a -> concat(a.out, substring(text, a.at + 1))) END"""
    )
    changed = found.select("row", done.alias("done"))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text_col] = F.coalesce("done", out[text_col])
    if length_col and length_col in out:
        out[length_col] = F.when(F.col("done").isNotNull(), F.length("done").cast(docs.schema[length_col].dataType)).otherwise(out[length_col])
    return changed.select(*[x.alias(c) for c, x in out.items()])
