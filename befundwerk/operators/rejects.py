"""Raw records that don't parse, set apart with the reason, beside the typed valid rows."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from befundwerk.functions.clean import SPACE_CHARS

#: A record whose quoted fields all end, with a separator or the end behind them (RE2).
WELL_QUOTED = r'(?s)\A(?:"(?:[^"]|"")*"|(?:[^";][^;]*)?)(?:;(?:"(?:[^"]|"")*"|(?:[^";][^;]*)?))*\z'
#: A whole number from 0 to 8, leading zeros and a fraction of zeros allowed, or nothing.
SCORE = r"\A(?:0*[0-8](?:\.0+)?)?\z"
#: Line ends inside a record travel through the parser as these code points.
BREAKS = {"\n": "\ue00a", "\r": "\ue00d"}
OUT = "nr long, datei string, grund string, felder array<string>"
OUT_ARROW = pa.schema([("nr", pa.int64()), ("datei", pa.string()), ("grund", pa.string()), ("felder", pa.list_(pa.string()))])


def split_record(record: str) -> list[str] | None:
    """The fields of one record by the format's rule, None if its quoting is broken; for records the block parser can't hold."""
    if not re.fullmatch(WELL_QUOTED[6:-2], record, re.S):
        return None
    return [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in re.findall(r'(?:^|(?<=;))("(?:[^"]|"")*"|(?:[^";][^;]*)?)(?:;|$)', record, re.S)] if record else [""]


def valid_scores(cells: pa.Array) -> pa.Array:
    """Whether each cell is a score; null and blank cells are."""
    trimmed = pc.utf8_trim(pc.fill_null(cells, ""), characters=SPACE_CHARS)
    return pc.match_substring_regex(trimmed, SCORE)


def parse_block(records: pa.Array, quoted: pa.Array, width: int) -> tuple[pa.Array, pa.Array, dict[int, str]]:
    """(places, fields as a list array, reasons by place) of a block of records without line ends.

    All records go through one CSV block, each with its place as an extra first field. A record whose
    quoting is broken would swallow those behind it, so its place stands alone in its row; both these
    and records with another number of fields come to the parser's invalid-row callback, which names
    the reason from the row.
    """
    n = len(records)
    places = pc.cast(pa.array(np.arange(n)), pa.string())
    lines = pc.if_else(quoted, pc.binary_join_element_wise(places, records, ";"), pc.binary_join_element_wise("!", places, ""))
    data = (pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), lines), "\n")[0].as_py() + "\n").encode()
    names = [f"c{i}" for i in range(width + 1)]
    reasons: dict[int, str] = {}

    def invalid(row: csv.InvalidRow) -> str:
        if row.text[:1] == "!":
            reasons[int(row.text[1:])] = "anfuehrung"
        else:
            reasons[int(row.text.partition(";")[0])] = "spaltenzahl"
        return "skip"

    t = csv.read_csv(
        io.BytesIO(data),
        read_options=csv.ReadOptions(column_names=names, block_size=len(data) + 1, use_threads=False),
        parse_options=csv.ParseOptions(delimiter=";", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False, null_values=[]),
    )
    if t.num_rows + len(reasons) != n:
        raise ValueError("the parser lost records")
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
    return pc.cast(columns[0], pa.int64()), list_rows([restore_breaks(c) for c in columns[1:]]), reasons


def restore_breaks(cells: pa.Array) -> pa.Array:
    for a, c in BREAKS.items():
        cells = pc.replace_substring(cells, c, a)
    return cells


def list_rows(columns: Sequence[pa.Array]) -> pa.Array:
    """Columns of equal length as one array of rows, each a list of its cells."""
    n, width = len(columns[0]), len(columns)
    at = (np.arange(n)[:, None] + n * np.arange(width)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.concat_arrays(columns).take(pa.array(at)))


def reject_batches(widths: dict[str, int], score_file: str, score_field: int, block: int = 4096) -> object:
    """The function for mapInArrow over (nr, datei, zeile)."""
    inside = "[" + "".join(BREAKS.values()) + "\\x00]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                nr, datei, zeile = (b.column(i) for i in range(3))
                zeile = pc.fill_null(zeile, "")
                quoted = pc.match_substring_regex(zeile, WELL_QUOTED)
                odd = pc.match_substring_regex(zeile, inside)
                flat = zeile
                for a, c in BREAKS.items():
                    flat = pc.replace_substring(flat, a, c)
                grund = np.full(b.num_rows, "datei", object)
                parts: list[pa.Array] = [pa.array([None], pa.list_(pa.string()))]
                source, size = np.zeros(b.num_rows, np.int64), 1
                for f, width in widths.items():
                    own = pc.fill_null(pc.equal(datei, f), False)
                    easy = np.flatnonzero(pc.and_(own, pc.invert(odd)).to_numpy(zero_copy_only=False))
                    if len(easy):
                        i = pa.array(easy)
                        places, fields, reasons = parse_block(flat.take(i), quoted.take(i), width)
                        grund[easy] = None
                        grund[easy[list(reasons)]] = list(reasons.values())
                        source[easy[places.to_numpy()]] = size + np.arange(len(fields))
                        parts.append(fields)
                        size += len(fields)
                    for i in np.flatnonzero(pc.and_(own, odd).to_numpy(zero_copy_only=False)):  # hardly any: signs that the block uses itself
                        x = split_record(zeile[i].as_py())
                        grund[i] = "anfuehrung" if x is None else None if len(x) == width else "spaltenzahl"
                        if grund[i] is None:
                            parts.append(pa.array([x], pa.list_(pa.string())))
                            source[i], size = size, size + 1
                strange = (grund == "datei") & ~quoted.to_numpy(zero_copy_only=False)
                grund[strange] = "anfuehrung"
                felder = pa.concat_arrays(parts).take(pa.array(source))
                scored = np.flatnonzero(pc.and_(pc.fill_null(pc.equal(datei, score_file), False), pc.is_valid(felder)).to_numpy(zero_copy_only=False))
                if len(scored):
                    ok = valid_scores(pc.list_element(felder.take(pa.array(scored)), score_field)).to_numpy(zero_copy_only=False)
                    grund[scored[~ok]] = "wert"
                yield pa.RecordBatch.from_arrays([nr, datei, pa.array(grund, pa.string()), felder], schema=OUT_ARROW)

    return run


#: Fields of each file of a delivery (fixed values of the format).
FIELDS = {
    "Berichte.csv": ("PatientID", "bername", "bertyp", "berdat", "diag", "epikrise", "jetziges_leiden", "prozedere"),
    "ICDSC.csv": ("PatientID", "ICDSC_Max"),
}


def parse_records(raw: DataFrame, nr: str = "roh_nr", datei: str = "datei", zeile: str = "zeile") -> DataFrame:
    """Every record as (nr, datei, grund, felder): ``felder`` if it parses, ``grund`` of the first failure if not.

    A null or empty record has one empty field, so its column count is wrong. A record of an unknown or
    null file is checked for its quoting and else rejected with ``datei``. Repeated
    records are rows of their own; further columns are ignored; an empty table gives no rows.
    """
    fn = reject_batches({f: len(c) for f, c in FIELDS.items()}, "ICDSC.csv", 1)
    return raw.select(F.col(nr).cast("long"), F.col(datei), F.col(zeile)).mapInArrow(fn, OUT)


def check_scores(df: DataFrame, nr: str, score: str) -> DataFrame:
    """(nr, grund) for a table's score column by the same kernel; grund is null for valid scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = valid_scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(ok, pa.scalar(None, pa.string()), pa.scalar("wert"))], names=["nr", "grund"])

    return df.select(F.col(nr).cast("long"), F.col(score)).mapInArrow(run, "nr long, grund string")
