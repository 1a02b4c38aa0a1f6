from quarryline.operators.reports import label_frequencies


def test_rare_labels_are_listed(spark):
    rows = spark.createDataFrame([(1, "Voltage, voltage; rating"), (2, "voltage"), (2, None)], "conv_id long, text string")
    assert sorted(map(tuple, label_frequencies(rows).collect())) == [("rating", 1, 1), ("voltage", 3, 2)]
