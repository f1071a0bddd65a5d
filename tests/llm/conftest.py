import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox, jumps over. " * 4000 + "é\n" * 50
AWKWARD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 3), (2, "one two three four five six seven eight nine ten", "en", None, 3), (3, None, None, "a", None), (4, "", "en", "b", 0),
    (5, LONG, "en", "a", 9), (6, LONG, "fr", "b", 9), (None, "no id at all here, dear reader", "en", "a", 1), (None, None, None, None, None), (7, " \n\t two  spaces\n\nand lines \n", "en", "c", 2),
    (8, "日本語のテキスト 😀 ünïcödé", "ja", "c", 2), (1, "one two three four five six seven eight nine ten", "en", "a", 3), (9, "x", "en", "z", 1),
]
#: Names that operators also use, of results and within.
CLASHES = {
    name: i if i % 2 else str(i)
    for i, name in enumerate(
        """shard slot score copies start sig rank size tokens target source_size taken law grown_shard th comp class_id n_links members block held_out predicted
        quality draw places n_tokens n_sections n_crossing part part_start ids ids_crc32 sample pieces inclusion round_trip n_bytes media tensor segments feature
        _mix_key _mix_n _mix_i _mix_c _mix_full _mix_whole _mix_end _mix_bucket _shard _grown _part _bucket _place _row _id _th _own _h _in _score _score_ _start
        d k g many c0 c1 c2 path sketch key count value starts""".split()
    )
}


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
