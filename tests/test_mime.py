"""T6 by Column functions against the Python library."""

import base64
import random
from email.header import decode_header, make_header

from pyspark.sql import functions as F

from cuelake.functions import mime
from cuelake.operators.mail import decode_mime


def library(v):
    try:
        return str(make_header(decode_header(v)))
    except Exception:
        return v


def word(rng):
    cs = rng.choice(["utf-8", "UTF-8", "us-ascii", "iso-8859-1", "ISO-8859-2", "iso-8859-7", "windows-1252", "koi8-r", "windows-1251"])
    data = rng.choice(["é€ж", "plain (x)", "ΑΩ", "", " a ", "x_y=z?", "日本"]).encode(rng.choice([cs, "utf-8"]), "ignore")
    if rng.random() < 0.1:
        data += bytes([rng.randrange(128, 256)])
    if rng.random() < 0.5:
        b = base64.b64encode(data).decode()
        return f"=?{cs}?{rng.choice('bB')}?{b.rstrip('=') if rng.random() < 0.3 else b}?="
    q = "".join("_" if c == 32 else chr(c) if chr(c).isalnum() and c < 128 else f"={c:02X}" for c in data)
    return f"=?{cs}?{rng.choice('qQ')}?{q}?="


def test_words_as_the_library_decodes_them(spark):
    rng = random.Random(7)
    plain = ["", " ", "  ", "a", " b ", "(c)", "\t", "=?", "?=", "=?x", "Re: ", "\\"]
    cases = ["".join(rng.choice([rng.choice(plain), word(rng)]) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    cases += ["", " x", "=?utf-8?Q?a=zz=4?=", "=?gb2312?B?xOO6ww==?=", "=?utf-8?B?a?=", "é =?utf-8?Q?a?=", "a\n =?utf-8?Q?b?=", "=??Q?a?="]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(-1, None)], "i int, s string").repartition(4)
    got = {r["i"]: r for r in df.select("i", decode_mime(F.col("s")).alias("d"), mime.covered(F.col("s")).alias("c")).collect()}
    assert got[-1]["d"] is None
    wrong = [(c, library(c), got[i]["d"]) for i, c in enumerate(cases) if got[i]["d"] != library(c)]
    assert not wrong, wrong[:2]
    assert sum(got[i]["c"] for i in range(1500)) > 800


def test_covered_values_are_decoded_without_python(spark):
    plan = spark.range(1).select(mime.decode_words(F.lit("=?utf-8?Q?a?=")).alias("d"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and plan.first()["d"] == "a"
