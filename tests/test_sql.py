"""The SQL surface gives what the DataFrame surface gives."""

from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.plans import sql, views

SF = "/root/testdata/sf0.001"


def test_functions_equal_columns(spark):
    sql.register(spark, SF)
    p = views.synth(spark, SF).limit(3000)
    p.createOrReplaceTempView("some")
    a, r, g, b = (F.col(c) for c in "argb")
    pairs = {
        "on_white(a, r, g, b)": color.on_white(a, r, g, b),
        "luma(r, g, b)": color.luma(r, g, b),
        "premultiplied(r, a)": color.premultiplied(r, a),
        "color_key(a, r, g, b)": color.exact_key(a, r, g, b),
        "coarse_color_key(a, r, g, b)": color.coarse_key_opaque(a, r, g, b),
        "srgb_to_linear(g)": color.srgb_to_linear(g),
        "blend(b, a, 255)": color.blend(b, a, F.lit(255)),
    }
    for text, column in pairs.items():
        assert p.filter(~F.expr(text).eqNullSafe(column)).count() == 0, text
    assert spark.sql("SELECT bit_depth(3), color_bin(300, 0, 1), color_bin(-1, 0, 1)").first() == (2, 255, 0)
    # Inlined: no Python in the plan.
    assert "Python" not in spark.sql("SELECT sum(on_white(a, r, g, b)) FROM some")._jdf.queryExecution().executedPlan().toString()


def test_views_and_table_function(spark):
    sql.register(spark, SF)
    assert spark.sql("SELECT count(*) FROM gray8").first()[0] == 64 * spark.sql("SELECT count(DISTINCT image_id) FROM gray8").first()[0]
    rows = spark.sql("SELECT type FROM png_chunks(unhex('89504E470D0A1A0A0000000049454E44AE426082'))").collect()
    assert [r.type for r in rows] == ["IEND"]
    assert spark.sql("SELECT image_size(unhex('474946383961050006000000000000000000')) AS s").first().s.width == 5
