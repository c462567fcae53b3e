"""String column functions: names, labels, titles, paths, report lines.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: display abbreviations, applied in this order (order matters,
# e.g. "determiner-noun" must be replaced before "agreement").
# ---------------------------------------------------------------------------
PHENOMENON_ABBREVIATIONS = [
    ("determiner-noun", "det. noun"),
    ("agreement", "agr."),
    ("argument", "arg."),
    ("coordinate", "coord."),
    ("structure", "struct."),
    ("attractor", "attr."),
    ("licensing", "lic."),
]

# FIXED VALUES: abbreviations for a paradigm's axis title, in this order,
# applied after "_" becomes " ".
TITLE_ABBREVIATIONS = [
    ("coordinate", "coord."),
    ("structure", "struct."),
    ("prepositional", "prep."),
    ("agreement", "agreem."),
    ("determiner", "det."),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace_all(col: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, col)


def paradigm_name(index: Column) -> Column:
    """``'p' || index`` for synthetic paradigm keys."""
    return F.concat(F.lit("p"), index.cast("string"))


def swap_middle_chars(s) -> Column:
    """Swap the characters at 1-based positions k and k+1, k = floor(length/2);
    strings shorter than two characters are returned unchanged."""
    s = _col(s)
    k = F.floor(F.length(s) / 2).cast("int")
    swapped = F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.lit(1)),
                       F.substring(s, k, F.lit(1)), F.substring(s, k + 2, F.lit(1 << 30)))
    return F.when(F.length(s) < 2, s).otherwise(swapped)


def lower_case_lines(s, flag) -> Column:
    """B1: lower-case when the (boolean column or literal) flag is true."""
    flag = flag if isinstance(flag, Column) else F.lit(bool(flag))
    return F.when(flag, F.lower(_col(s))).otherwise(_col(s))


# FIXED VALUES: the characters Python's str.isspace accepts, as a regex class.
UNICODE_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip_whitespace(s) -> Column:
    """B2: like Python ``str.strip()``: all leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(_col(s), f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")


def shorten_phenomenon(c) -> Column:
    """K1."""
    return _replace_all(_col(c), PHENOMENON_ABBREVIATIONS)


def paradigm_title(phenomenon, paradigm) -> Column:
    """K2: two-line axis title."""
    name = F.concat(_col(phenomenon), F.lit("\n"), _col(paradigm))
    return _replace_all(F.replace(name, F.lit("_"), F.lit(" ")), TITLE_ABBREVIATIONS)


def paradigm_label(file_name, phenomenon, mode: str = "charset") -> Column:
    """K3: paradigm label with the phenomenon removed from the front.

    ``mode='charset'`` reproduces character-set stripping (every leading char
    that occurs in the phenomenon goes, e.g. "anaphor gender agreement" by
    "anaphor agreement" -> "der agreement"); ``mode='prefix'`` strips the
    phenomenon only as a whole prefix.
    """
    spaced = F.replace(_col(file_name), F.lit("_"), F.lit(" "))
    if mode == "charset":
        return F.ltrim(F.ltrim(spaced, _col(phenomenon)), F.lit("-"))
    if mode == "prefix":
        stripped = F.when(F.startswith(spaced, _col(phenomenon)),
                          F.substring(spaced, F.length(_col(phenomenon)) + 1, F.lit(1 << 30))
                          ).otherwise(spaced)
        return F.regexp_replace(stripped, "^[- ]+", "")
    raise ValueError(f"unknown mode {mode!r}")


def group_name(model, corpora) -> Column:
    """K4: ``model + '+' + corpora``; NULL if either side is NULL."""
    return F.concat(_col(model), F.lit("+"), _col(corpora))


def shorten_path(path, checkpoint_root: str, runs_root: str) -> Column:
    """K5: path relative to the fairseq root for checkpoint files, else to the runs root.

    Paths outside the chosen root are returned unchanged.
    """
    p = _col(path)
    name = F.regexp_extract(p, r"([^/]*)/?$", 1)

    def rel(root: str) -> Column:
        # like Path.relative_to: no trailing separator on the result
        prefix = root.rstrip("/") + "/"
        return F.when(F.startswith(p, F.lit(prefix)),
                      F.regexp_replace(F.substring(p, len(prefix) + 1, 1 << 30), "/$", "")).otherwise(p)

    return F.when(F.startswith(name, F.lit("checkpoint")), rel(checkpoint_root)).otherwise(rel(runs_root))


def round_half_even(c, digits: int) -> Column:
    """K6: round like NumPy/pandas on doubles (half to even on the scaled value).

    Spark ``round`` is half-up: 0.125 -> 0.13, here 0.12.
    """
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def param_name(i) -> Column:
    """K9: ``param_{i:03}``: at least three digits, none cut."""
    n = _col(i).cast("string")
    return F.concat(F.lit("param_"), F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0")))


def dotted_name(name, width: int = 64) -> Column:
    """Left-justify ``name`` with dots to ``width``; never truncate (like Python)."""
    n = _col(name)
    return F.when(F.length(n) >= width, n).otherwise(F.rpad(n, width, "."))


def fixed(c, width: int, decimals: int) -> Column:
    """Python ``f'{x:>{width}.{decimals}f}'``, with 'nan' for NULL/NaN."""
    x = _col(c)
    txt = F.format_string(f"%.{decimals}f", x)
    txt = F.when(x.isNull() | F.isnan(x), F.lit("nan")).otherwise(txt)
    return F.when(F.length(txt) >= width, txt).otherwise(F.lpad(txt, width, " ")) if width else txt


def report_line(group, accuracy, n, margin) -> Column:
    """One line of the group report."""
    nn = _col(n)
    n_txt = F.when(F.length(nn.cast("string")) >= 2, nn.cast("string")).otherwise(F.lpad(nn.cast("string"), 2, " "))
    return F.concat(dotted_name(group, 64), F.lit("accuracy="), fixed(accuracy, 0, 2),
                    F.lit(" n="), n_txt, F.lit(" margin-of-error="), fixed(margin, 8, 2))
