from pyspark.sql import functions as F

from quarryline.functions.text import plain_numbers

#: From the original's own description, and by its rule.
WANT = {
    "1,050.00 lbs": "1050.00 lbs", "1.050,00 kg": "1050.00 kg", "12,345 A": "12345 A", "1,5 kg": "1.5 kg", "1.05": "1.05", "0,112 mm": "0.112 mm", "from 1,234,567 to 2,5, or 3.": "from 1234567 to 2.5, or 3.",
    "1,2,3": "1.2.3", "1.2.3": "1.2.3", "01,234": "01.234", "1.234.567": "1234567", "": "", "no number": "no number", "a7b": "a7b",
}


def test_numbers_inside_texts(spark):
    rows = spark.createDataFrame([(k,) for k in [*WANT, None]], "t string").select("t", plain_numbers(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == {**WANT, None: None}
