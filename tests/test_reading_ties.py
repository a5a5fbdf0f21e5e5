"""Items of one place and number are read in an order that their rows fix."""

from folioloom.operators import layout


def test_items_of_one_place_are_read_by_width_then_text(spark):
    box = lambda x1: (1.0, 2.0, x1, 14.0)
    rows = [("d", "a", 1, text, box(x1), 7) for text, x1 in (("N1", 40.0), ("R1", 30.0), ("A1", 40.0), ("B1", 50.0))]
    schema = "document_id string, item_id string, page_number int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, ord long"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = layout.reading_order(spark.createDataFrame(order, schema)).orderBy("reading_order").collect()
        assert [r.text for r in got] == ["R1", "A1", "N1", "B1"]
