"""Archives that arrive in two batches come out as their elements, a broken one as an entry with the reason."""

from folioframe.operators import document as D
from folioframe.sources import package as P
from folioframe.streaming import packages


def test_arriving_packages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    archive = bytes(P.pack(spark.createDataFrame(P.blank(), P.ENTRIES)).first().archive)
    (folder / "a.zip").write_bytes(archive)

    def run(df, name):
        df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}")

    assert D.paragraph_texts(run(packages.flattened(spark, str(folder)), "out")).count() == 1
    (folder / "b.zip").write_bytes(archive)
    (folder / "c.zip").write_bytes(b"no archive")
    assert D.paragraph_texts(run(packages.flattened(spark, str(folder)), "out")).count() == 2
    assert run(packages.arriving(spark, str(folder)), "entries").where("path = '#error'").count() == 1
