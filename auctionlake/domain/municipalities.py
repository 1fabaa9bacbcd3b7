"""The towns that end a listing's address, and the join that finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Towns and places of each county as listings write them.
MUNICIPALITIES = {
    "Camden": [
        "Audubon", "Barrington", "Bellmawr", "Blackwood", "Camden", "Cherry Hill", "Clementon", "Collingswood", "Gibbsboro", "Glendora", "Gloucester City", "Gloucester Township",
        "Haddon Heights", "Haddon Township", "Laurel Springs", "Lawnside", "Lindenwold", "Magnolia", "Mount Ephraim", "Oaklyn", "Pennsauken", "Pine Hill", "Runnemede", "Sicklerville",
        "Somerdale", "Stratford", "Voorhees", "Waterford Works", "West Berlin", "Winslow", "Winslow Township", "Woodlynne",
    ],
    "Cape May": [
        "Avalon", "Cape May", "Cape May Court House", "Dennisville", "Erma", "Goshen", "Green Creek", "Lower Township", "Marmora", "North Cape May", "Ocean City", "Rio Grande",
        "Sea Isle City", "Stone Harbor", "Villas", "Wildwood", "Wildwood Crest", "Woodbine",
    ],
    "Monmouth": [
        "Allenhurst", "Allentown", "Asbury Park", "Atlantic Highlands", "Avon-by-the-Sea", "Belmar", "Bradley Beach", "Brielle", "Clarksburg", "Cliffwood", "Cliffwood Beach", "Colts Neck",
        "Deal", "Eatontown", "Englishtown", "Fair Haven", "Farmingdale", "Freehold", "Freehold Township", "Hazlet", "Highlands", "Holmdel", "Howell", "Interlaken", "Keansburg", "Keyport",
        "Lake Como", "Leonardo", "Little Silver", "Loch Arbour", "Long Branch", "Manalapan", "Manasquan", "Marlboro", "Matawan", "Middletown Township", "Millstone", "Monmouth Beach",
        "Morganville", "Neptune", "Neptune City", "Neptune Township", "North Middletown", "Oakhurst", "Ocean Grove", "Ocean Township", "Oceanport", "Red Bank", "Roosevelt", "Rumson",
        "Sea Bright", "Sea Girt", "Shrewsbury", "Spring Lake", "Spring Lake Heights", "Tinton Falls", "Union Beach", "Upper Freehold", "Wall", "Wall Township", "West Allenhurst",
        "West Long Branch",
    ],
}
#: Words of the longest name that is looked for.
MOST_WORDS = 5


def municipalities(spark: SparkSession) -> DataFrame:
    """(county, municipality) of every town known."""
    return spark.createDataFrame([(county, name) for county, names in MUNICIPALITIES.items() for name in names], "county string, municipality string")


def with_suffix_municipality(df: DataFrame, column: str, names: DataFrame, out: str, words: int = MOST_WORDS) -> DataFrame:
    """Adds as ``out`` the longest municipality that ends the text as whole words, in its own spelling; null where none does.

    The last one to ``words`` words are each looked up by a hash join with the names, a table of a few hundred rows at most
    (a dimension, hence broadcast), so a text costs as many lookups whatever the number of names. Single spaces stand between
    the words of both; a name of more words is never found.
    """
    own = names.select(F.lower("municipality").alias("key_"), F.col("municipality").alias("name_")).groupBy("key_").agg(F.min("name_").alias("name_"))
    d = df.withColumn("words_", F.split(F.lower(F.col(column)), r"\s+"))
    for n in range(words, 0, -1):
        found = F.broadcast(own.select(F.col("key_").alias(f"k{n}_"), F.col("name_").alias(f"m{n}_")))
        tail = F.when(F.size("words_") >= n, F.array_join(F.slice("words_", -n, n), " "))
        d = d.withColumn(f"t{n}_", tail).join(found, F.col(f"t{n}_") == F.col(f"k{n}_"), "left").drop(f"t{n}_", f"k{n}_")
    longest = F.coalesce(*[F.col(f"m{n}_") for n in range(words, 0, -1)])
    return d.withColumn(out, longest).drop("words_", *[f"m{n}_" for n in range(1, words + 1)])
