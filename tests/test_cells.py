"""Cell semantics: tables of edge cases, and texts written from known numbers and dates."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewash.functions import (
    boolean_like,
    coerce_boolean,
    coerce_date,
    coerce_number,
    date_shape,
    formatted_number,
    is_blank,
    norm_key,
    num_text,
    round_display,
    strip,
)
from tablewash.functions.dates import MONTHS

def written_numbers():
    """Texts made from known numbers, each with the number it was made from."""
    rng = random.Random(11)
    gaps = ["", " ", "\t", "\u00a0"]
    for _ in range(3000):
        value = Decimal(rng.randrange(10 ** rng.randint(1, 9))) / 10 ** rng.choice([0, 0, 2])
        digits = f"{value:,}" if rng.random() < 0.5 else f"{value}"
        if rng.random() < 0.3:
            digits = rng.choice("$€£¥₹") + rng.choice(gaps) + digits
        style = rng.choice(["plain", "minus", "brackets", "percent"])
        if style == "minus":
            digits, value = "-" + digits, -value
        elif style == "brackets":
            digits, value = f"({digits})", -value
        elif style == "percent":
            digits, value = digits + rng.choice(gaps) + "%", value / 100
        yield rng.choice(gaps) + digits + rng.choice(gaps), float(value) + 0.0


def test_written_numbers_are_read_back(cells):
    pairs = list(written_numbers())
    assert cells(coerce_number, [text for text, _ in pairs]) == pytest.approx([value for _, value in pairs])


def test_broken_numbers_are_none(cells):
    rng = random.Random(12)
    whole = [str(rng.randrange(1, 10**6)) for _ in range(300)]
    broken = [f(d) for d in whole for f in (lambda d: d + "x", lambda d: "+" + d, lambda d: d + ".", lambda d: d[:1] + "/" + d, lambda d: "1.2." + d)]
    assert cells(coerce_number, broken) == [None] * len(broken)


def written_dates(day_first):
    """Texts made from known days, each with that day."""
    rng = random.Random(13)
    for _ in range(3000):
        day = date(rng.randint(1970, 2069), 1, 1) + timedelta(days=rng.randrange(365))
        y, m, d = day.year, day.month, day.day
        name = MONTHS[m - 1].capitalize() + rng.choice(["", "xx"])
        short = y if y < 2000 else rng.choice([y, f"{y % 100:02d}"])
        pair = f"{d}.{m}" if day_first else f"{m}.{d}"
        texts = [f"{y}-{m:02d}-{d:02d}", f"{y}-{m}-{d} later", f"{y}/{m}/{d}", f"{d} {name} {short}", f"{name} {d},\t{short}"]
        texts.append(f"{pair}.{rng.choice([y, f'{y % 100:02d}'])}")
        if d > 12:
            texts += [f"{d}/{m}/{y}", f"{m}/{d}/{y}"]  # the day says which it is
        yield rng.choice(["", " ", "\u3000"]) + rng.choice(texts) + rng.choice(["", " "]), day.isoformat()


@pytest.mark.parametrize("day_first", [False, True])
def test_written_dates_are_read_back(cells, day_first):
    pairs = list(written_dates(day_first))
    assert cells(lambda c: coerce_date(c, day_first), [text for text, _ in pairs]) == [day for _, day in pairs]


def test_broken_dates_are_none(cells):
    texts = [f"{a}/{b}/2020" for a in range(13, 40, 3) for b in range(13, 40, 3)]
    texts += [f"5 {word} 2020" for word in ("foo", "mai5", "x", "dezember 1")] + [f"2020-{m}-{d}" for m, d in ((0, 1), (1, 0), (13, 1), (1, 32))]
    assert cells(coerce_date, texts) == [None] * len(texts)


def test_number_edges(cells):
    cases = {
        "¥39,545": 39545, "(30548)": -30548, "12%": 0.12, "(12%)": -0.12, "(-5)": -5, "1 234": 1234, "1%2": 12,
        ".5": 0.5, "1e5": 1e5, "-0": 0, "- 5": -5, "-$5": -5,
        "5.": None, "+5": None, "--5": None, "(12)%": None, "$(5)": None, "5d": None, "1e999": None, "-": None,
        "": None, "N/A": None, "٣": None,
    }
    assert cells(coerce_number, list(cases)) == list(cases.values())


def test_date_edges(cells):
    cases = {
        "2026-01-01": "2026-01-01", "2026-1-5x": "2026-01-05", "2026-02-31": "2026-02-31", "2026-01-123": "2026-01-12",
        "22.10.2026": "2026-10-22", "04/08/2026": "2026-04-08", "15 Jul 2026": "2026-07-15",
        "Jul 15, 26": "2026-07-15", "1/2/69": "2069-01-02", "1/2/70": "1970-01-02", "1 jan 99": "2099-01-01",
        "2020/1/2": "2020-01-02", "13/13/2020": None, "0000-1-1": None, "Foo 1, 2020": None, "20260105": None,
    }
    assert cells(coerce_date, list(cases)) == list(cases.values())


def test_blanks(cells):
    blanks = [None, "", " ", "\t　", "na", "N/A", " NULL ", "none", "Nil", "-", "--", "?"]
    assert cells(is_blank, blanks) == [True] * len(blanks)
    assert cells(is_blank, ["0", "n.a.", "---", "no"]) == [False] * 4


def test_shapes_and_keys(cells):
    shapes = cells(date_shape, ["2026-01-05T10:00", "2026-1-5", "1.2.26", "12 Mar 2026", "Mar 12, 2026", "x"])
    assert [s and s.split()[0] for s in shapes] == ["ISO", None, "slash/dot", "text", "text", None]
    assert cells(norm_key, [" To-kyo_1 ", "to  KYO.1", "Tokyo."]) == ["to kyo 1", "to kyo 1", "tokyo "]
    assert cells(strip, [" a b﻿"]) == ["a b"]


def test_words_and_layout(cells):
    assert cells(boolean_like, ["Yes", " n ", "1", "2", None]) == [True, True, True, False, None]
    assert cells(coerce_boolean, ["Y", "FALSE", "0", "maybe"]) == [True, False, False, None]
    assert cells(formatted_number, ["-$1,000.5 %", "1e5", "(5", ""]) == [True, False, True, False]


def test_number_text(spark):
    cases = {
        39545.0: "39545", 0.07: "0.07", 12345678.5: "12345678.5", 1e21: "1e+21", 1.5e-7: "1.5e-7", 1e-6: "0.000001",
        -0.0: "0", 1e20: "100000000000000000000", 0.30000000000000004: "0.30000000000000004", -1.5: "-1.5",
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(num_text(F.col("x"))).collect()] == list(cases.values())
    rounded = spark.createDataFrame([(0, 99.456), (1, 100.5), (2, -187848.4)], "i int, x double").orderBy("i")
    assert [r[0] for r in rounded.select(round_display(F.col("x"))).collect()] == [99.46, 101.0, -187848.0]
