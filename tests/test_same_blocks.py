"""A block's encoding does not depend on the blocks that are encoded with it."""

import duckdb

from blockframe.functions import codec, matches
from blockframe.plans import catalogue


def test_block_alone_and_after_another():
    # as the second block of a line, b"gckus" and b"axxew" once had one hash, and the second hid the first
    block = b"gckus0123456789abcdef--axxew--gckus0123456789abcdef" + b"." * 200
    for level in (3, 5, 6):
        assert codec.encode_blocks([b"another one", block], level)[1] == codec.encode_blocks([block], level)[0]


def test_dictionary_ends_before_the_block():
    # the dictionary's last bytes and the block's first ones are no candidate
    line = matches.Line([b"klm....abcklm"], b"abcklm----ab")
    assert line.longest(1)[0].tolist()[12:] == [0] * 7 + [6, 5, 0, 0, 0, 0, 0]


def test_query_with_null_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "a text " * 900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = catalogue.encode_by_block(spark, str(tmp_path)).select("doc_id", "text_md5", "same", "error").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(catalogue.ORACLE_SQL["encode_by_block"]).fetchall())
