import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows and a schema text to a table of several files, read back: what operators are given."""
    import uuid

    from recsuite.session import ensure_checkpoint_dir

    def build(rows, schema, parts=3):
        path = f"{ensure_checkpoint_dir(spark)}/fixture-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)
    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that every operator has to stand: NULL, empty, blank, one word, very long, ties, other scripts."""
    return [None, "", " \n\t", "word", "a b", "Z" * 5000, "the quick brown fox " * 2500, "日本語 テキスト🙂", "x\x00y",
            "ÀÉÎ straße İstanbul ΣΑΣ", "the end", "the end"]
