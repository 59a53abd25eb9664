"""Number formats of automatic numbering as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units of each script.
COUNTING = ("一二三四五六七八九", "十", "百", "千")
LEGAL = ("壹贰叁肆伍陆柒捌玖", "拾", "佰", "仟")
STEMS = "甲乙丙丁戊己庚辛壬癸"
CIRCLES = "①②③④⑤⑥⑦⑧⑨⑩"


def _place(n: Column, unit: int) -> Column:
    return F.floor(n / unit) % 10


def chinese(n: Column, script: tuple[str, str, str, str]) -> Column:
    """1 to 9999 in words, with one zero word for a gap; other numbers in digits."""
    digits, ten, hundred, thousand = script
    digit = lambda d: F.substring(F.lit(digits), d.cast("int"), F.lit(1))
    q, h, t, o = (_place(n, u) for u in (1000, 100, 10, 1))
    below, rest = n % 1000, n % 100
    parts = [
        F.when(q > 0, F.concat(digit(q), F.lit(thousand))),
        F.when((q > 0) & (below > 0) & (below < 100), "零"),
        F.when(h > 0, F.concat(digit(h), F.lit(hundred))),
        F.when((h > 0) & (rest > 0) & (rest < 10), "零"),
        F.when(t > 0, F.concat(F.when((t == 1) & (h == 0), "").otherwise(digit(t)), F.lit(ten))),
        F.when(o > 0, digit(o)),
    ]
    return F.when((n >= 1) & (n <= 9999), F.concat_ws("", *parts)).otherwise(n.cast("string"))


def letters(n: Column, first: str = "a") -> Column:
    """a to z, aa, ab, ...: bijective numbers of base 26."""
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).alias("n"), F.concat(F.char((s["n"] - 1) % 26 + ord(first)), s["out"]).alias("out"))).otherwise(s)
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("out"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["out"]).otherwise(n.cast("string"))


def roman(n: Column) -> Column:
    """Thousands repeat without bound."""
    def place(d: Column, one: str, five: str, ten: str) -> Column:
        shapes = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, shapes)), (d + 1).cast("int"))

    parts = [F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(_place(n, 100), "c", "d", "m"), place(_place(n, 10), "x", "l", "c"), place(_place(n, 1), "i", "v", "x")]
    return F.when(n >= 1, F.concat(*parts)).otherwise(n.cast("string"))


def stems(n: Column) -> Column:
    return F.when(n >= 1, F.substring(F.lit(STEMS), ((n - 1) % 10 + 1).cast("int"), F.lit(1))).otherwise(n.cast("string"))


def circles(n: Column) -> Column:
    return F.when((n >= 1) & (n <= 10), F.substring(F.lit(CIRCLES), n.cast("int"), F.lit(1))).otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "decimal": lambda n: n.cast("string"),
    "chineseCountingThousand": lambda n: chinese(n, COUNTING),
    "chineseLegalSimplified": lambda n: chinese(n, LEGAL),
    "ideographDigital": lambda n: chinese(n, COUNTING),
    "ideographTraditional": stems,
    "lowerLetter": letters,
    "upperLetter": lambda n: letters(n, "A"),
    "lowerRoman": roman,
    "upperRoman": lambda n: F.upper(roman(n)),
    "decimalEnclosedCircle": circles,
    "bullet": lambda n: F.lit("").cast("string"),
}


def number_text(kind: Column, n: Column) -> Column:
    """n in the format that `kind` names; an unknown format counts as decimal."""
    out = None
    for name, shape in FORMATS.items():
        out = F.when(kind == name, shape(n)) if out is None else out.when(kind == name, shape(n))
    return out.otherwise(n.cast("string"))
