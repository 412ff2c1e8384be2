"""One consistent form of text that looks the same but is written with different characters.

Each Arrow partition runs one DuckDB statement: nfc_normalize composes separate marks, translate maps full-width
letters and digits, spaces, look-alike letters and all other compatibility forms of one letter, digit or symbol
(mathematical, circled, half-width, superscript), regular expressions drop invisible characters and open characters that
stand for several. The same statement says which kinds of difference a text had; compatibility forms other than
full-width and of several Latin letters are mapped but are no kind.

Null stays null and an empty text stays empty. Joiners between emoji stay, as do full-width punctuation and words of
one script. In a word that mixes scripts, look-alikes are mapped to Cyrillic where it has a letter only Cyrillic has,
else to Latin; letters without a look-alike stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the kinds of difference.
KINDS = {"wide": 1, "marks": 2, "invisible": 4, "space": 8, "ligature": 16, "mixed": 32}

# Letters of Cyrillic and Greek and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԛԝһ"
CYRILLIC_AS = "ABESIJKMHOPCTYX3aesijopcyxqwh"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικυαρ"
GREEK_AS = "ABEZHIKMNOPTYXovikuap"
#: Latin letters and the letters of Russian they look like.
LATIN = "ABEKMHOPCTYXaeopcyxëËu"
LATIN_AS = "АВЕКМНОРСТУХаеорсухёЁи"
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
SPACES = "               　\t\n\r\u0085  "
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{E0020}-\x{E007F}"
#: Stands for a joiner inside emoji while others are dropped.
_KEPT = ""


@cache
def several() -> dict[str, str]:
    """Characters that stand for two or more Latin letters, by Unicode's compatibility forms; the number sign isn't one."""
    out = {}
    for c in range(0x80, 0x20000):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) > 1 and c != 0x2116 and form.isalpha() and all("LATIN" in unicodedata.name(x, "") for x in form):
            out[chr(c)] = form
    return out


@cache
def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Other compatibility forms of letters, digits and symbols: of one character, and of several. Punctuation and spaces stay.

    So do the number sign, the two fillers that count as invisible, and what `narrow` and `several` map.
    """
    one, many, known = {}, {}, several()
    for c in (*range(0xA0, 0xD800), *range(0xF900, 0x32000)):
        ch = chr(c)
        form = unicodedata.normalize("NFKC", ch)
        if form == unicodedata.normalize("NFC", ch) or ch in known or c in (0x2116, 0x3164, 0xFFA0) or 0xFF01 <= c <= 0xFF5E or unicodedata.category(ch)[0] not in "LNSM" or " " in form:
            continue
        (one if len(form) == 1 else many)[ch] = form
    return one, many


def _class(chars: dict[str, str]) -> str:
    """A class of a regular expression of these characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _macros() -> list[str]:
    wide = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    ligatures = several()
    opened = "s"
    common = [c for c in ligatures if "ﬀ" <= c <= "ﬆ"]
    for c in common:
        opened = f"replace({opened}, {_quote(c)}, {_quote(ligatures[c])})"
    rest = [c for c in ligatures if c not in common]
    table = "MAP {" + ", ".join(f"{_quote(c)}: {_quote(form)}" for c, form in ligatures.items()) + "}"
    rare = "[" + "".join(rest) + "]"
    piece = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+"
    cyrillic_only = r"[\p{Cyrillic}]"
    mixed = "|".join(rf"[\p{{{a}}}][\p{{N}}\p{{M}}]*[{''.join(rf'\p{{{b}}}' for b in ('Latin', 'Greek', 'Cyrillic') if b != a)}]" for a in ("Latin", "Greek", "Cyrillic"))
    return [
        rf"CREATE MACRO held(s) AS regexp_replace(regexp_replace(s, '([{_EMOJI}])\x{{200D}}([{_EMOJI}])', '\1{_KEPT}\2', 'g'), '([{_EMOJI}])\x{{200D}}([{_EMOJI}])', '\1{_KEPT}\2', 'g')",
        f"CREATE MACRO seen(s) AS regexp_replace(s, '[{INVISIBLE}]', '', 'g')",
        f"CREATE MACRO spaced(s) AS translate(s, {_quote(SPACES)}, '{' ' * len(SPACES)}')",
        f"CREATE MACRO narrow(s) AS translate(s, {_quote(wide)}, {_quote(narrow)})",
        f"CREATE MACRO spelled(s) AS CASE WHEN regexp_matches(s, '{rare}') THEN list_aggregate(list_transform(string_split(s, ''), lambda c: coalesce({table}[c], c)), 'string_agg', '') ELSE {opened} END",
        f"CREATE MACRO is_mixed(s) AS regexp_matches(s, '{mixed}')",
        f"CREATE MACRO one_script(w) AS CASE WHEN NOT is_mixed(w) THEN w WHEN regexp_matches(translate(w, {_quote(CYRILLIC)}, ''), '{cyrillic_only}') THEN translate(translate(w, {_quote(GREEK)}, {_quote(GREEK_AS)}), {_quote(LATIN)}, {_quote(LATIN_AS)}) ELSE translate(translate(w, {_quote(CYRILLIC)}, {_quote(CYRILLIC_AS)}), {_quote(GREEK)}, {_quote(GREEK_AS)}) END",
        f"CREATE MACRO unmixed(s) AS CASE WHEN is_mixed(s) THEN list_aggregate(list_transform(regexp_extract_all(s, '{piece}'), lambda w: one_script(w)), 'string_agg', '') ELSE s END",
    ]


def _compatible_macro(present: set[str]) -> str:
    """compatible(s) for the compatibility forms that occur in a batch: translated or opened, then composed."""
    one, many = ({c: forms[c] for c in sorted(present) if c in forms} for forms in compatible())
    mapped = f"translate(s, {_quote(''.join(one))}, {_quote(''.join(one.values()))})" if one else "s"
    for c, form in many.items():
        mapped = f"replace({mapped}, {_quote(c)}, {_quote(form)})"
    return f"CREATE OR REPLACE MACRO compatible(s) AS {f'nfc_normalize({mapped})' if present else 's'}"


def _present(fields: int) -> str:
    """The different compatibility forms of a batch."""
    one, many = compatible()
    found = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(t{k}, '{_class(one | many)}')) AS c FROM batch WHERE regexp_matches(t{k}, '{_class(one | many)}')" for k in range(fields))
    return f"SELECT DISTINCT c FROM ({found})"


def _statement(fields: list[str], ids: list[str]) -> str:
    ascii_only = r"'[^\x00-\x08\x0E-\x7F]|[\t\n\r]'"
    steps = []
    for k, _ in enumerate(fields):
        steps.append((
            f"regexp_matches(t{k}, {ascii_only}) AS x{k}, CASE WHEN x{k} THEN held(t{k}) ELSE t{k} END AS h{k}, CASE WHEN x{k} THEN seen(h{k}) ELSE t{k} END AS v{k}, CASE WHEN x{k} THEN spelled(narrow(spaced(nfc_normalize(v{k})))) ELSE t{k} END AS n{k}",
            f"CASE WHEN x{k} THEN replace(unmixed(compatible(n{k})), '{_KEPT}', '‍') ELSE t{k} END AS o{k}, "
            rf"CASE WHEN NOT x{k} THEN 0 ELSE regexp_matches(t{k}, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]')::INT + 2 * regexp_matches(v{k}, '\p{{L}}\p{{M}}')::INT + 4 * (h{k} <> v{k})::INT"
            rf" + 8 * regexp_matches(t{k}, '[{SPACES}]')::INT + 16 * regexp_matches(v{k}, '[{''.join(several())}]')::INT + 32 * is_mixed(n{k})::INT END AS k{k}",
        ))
    inner = ", ".join(a for a, _ in steps)
    outer = ", ".join(b for _, b in steps)
    return f"SELECT {''.join(f'{i}, ' for i in ids)}{outer} FROM (SELECT *, {inner} FROM batch)"


def normalize(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The id column, each field in its consistent form, and <field>_kinds: the sum of the KINDS it had (null: null text)."""
    src = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields)])
    schema = T.StructType([src.schema["id"], *[f for k in range(len(fields)) for f in (T.StructField(f"o{k}", T.StringType()), T.StructField(f"k{k}", T.IntegerType()))]])
    macros, statement, present = _macros(), _statement(fields, ["id"]), _present(len(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            for m in macros:
                con.execute(m)
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                con.execute(_compatible_macro({c for (c,) in con.execute(present).fetchall()}))
                out = con.sql(statement).to_arrow_table()
                con.unregister("batch")
                cols = [out.column(f.name).combine_chunks().cast(b.schema.field("id").type if f.name == "id" else pa.string() if f.name[0] == "o" else pa.int32()) for f in schema.fields]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[f.name for f in schema.fields])
        finally:
            con.close()

    out = src.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *[x for k, c in enumerate(fields) for x in (F.col(f"o{k}").alias(c), F.col(f"k{k}").alias(f"{c}_kinds"))])


def found(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field): the fields that had any difference."""
    wide = normalize(df, id_col, fields)
    hits = F.array(*[F.when(F.col(f"{c}_kinds") > 0, F.lit(c)) for c in fields])
    return wide.select(id_col, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("field"))
