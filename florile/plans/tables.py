"""The tables of a folder, and their bindings to catalogs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, bind


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Catalog:
    return bind(read(spark, sf_dir, "documents"), "doc_id", text={"comment": "text", "format": "lang", "folder": "source"}, number={"size": "n_chars"}, haystack=("comment", "format", "folder"))


def labelled(spark: SparkSession, sf_dir: str) -> Catalog:
    """documents with their labels, which may be absent."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return bind(rows, "doc_id", text={"comment": "text", "format": "lang", "folder": "source"}, number={"size": "n_chars", "track": "quality", "year": "toxic"}, flag={"lossless": F.col("quality") == 1, "modifiedflag": F.col("toxic") == 1})


def parts(spark: SparkSession, sf_dir: str) -> Catalog:
    return bind(
        read(spark, sf_dir, "part"), "p_partkey", text={"title": "p_name", "album": "p_brand", "format": "p_type"}, multi={"genre": F.split("p_name", " "), "artist": F.array("p_brand", "p_type")}, number={"size": "p_size", "bitrate": "p_retailprice", "track": "p_size"}, name="p_name"
    )


def orders(spark: SparkSession, sf_dir: str) -> Catalog:
    return bind(read(spark, sf_dir, "orders"), "o_orderkey", text={"comment": "o_orderstatus", "label": "o_orderpriority"}, number={"size": "o_totalprice", "artist": "o_custkey", "year": F.year("o_orderdate")})


#: SQL for the formats, as they have to be: name, place from 0, and what each can do.
FORMATS_SQL = """(SELECT format, i - 1 AS i, format NOT IN ('mkv', 'mka', 'webm') AS readable, format NOT IN ('aiff', 'aif', 'aifc', 'wma', 'tak', 'mkv', 'mka', 'webm', 'dsf', 'dff') AS writable,
  format NOT IN ('aac', 'wav', 'aiff', 'aif', 'aifc', 'mkv', 'mka', 'webm', 'dsf', 'dff') AS artwork, format IN ('mp3', 'aac', 'm4a', 'm4b', 'mp4', 'ogg', 'opus', 'flac', 'alac') AS lyrics,
  format IN ('mp3', 'm4a', 'm4b', 'mp4', 'ogg', 'opus', 'spx', 'flac', 'alac', 'mpc', 'wv', 'tta', 'ofr', 'ofs', 'wvp') AS multi,
  format IN ('flac', 'alac', 'wav', 'aiff', 'aif', 'aifc', 'ape', 'wv', 'tta', 'tak', 'ofr', 'ofs', 'wvp', 'dsf', 'dff') AS lossless
  FROM (SELECT unnest(x) AS format, generate_subscripts(x, 1) AS i FROM (SELECT ['mp3', 'aac', 'm4a', 'm4b', 'mp4', 'ogg', 'opus', 'spx', 'flac', 'alac', 'wav', 'aiff', 'aif', 'aifc', 'ape', 'wma', 'mpc', 'wv', 'tta', 'tak', 'ofr', 'ofs', 'wvp', 'mkv', 'mka', 'webm', 'dsf', 'dff'] AS x))) AS f"""
