"""Geographic enrichment: state, region and tier of cities or countries, and suggestions for misspelt names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.functions.similarity import closest
from grainmill.functions.text import strip

# Name, state, region, tier of the known cities.
CITIES = """
delhi, Delhi, North India, 1
new delhi, Delhi, North India, 1
gurgaon, Haryana, North India, 1
gurugram, Haryana, North India, 1
noida, Uttar Pradesh, North India, 1
lucknow, Uttar Pradesh, North India, 2
kanpur, Uttar Pradesh, North India, 2
agra, Uttar Pradesh, North India, 2
varanasi, Uttar Pradesh, North India, 2
allahabad, Uttar Pradesh, North India, 2
prayagraj, Uttar Pradesh, North India, 2
meerut, Uttar Pradesh, North India, 2
jaipur, Rajasthan, North India, 2
jodhpur, Rajasthan, North India, 2
udaipur, Rajasthan, North India, 2
chandigarh, Chandigarh, North India, 2
amritsar, Punjab, North India, 2
ludhiana, Punjab, North India, 2
dehradun, Uttarakhand, North India, 2
shimla, Himachal Pradesh, North India, 3
srinagar, J&K, North India, 3
jammu, J&K, North India, 3
faridabad, Haryana, North India, 2
bangalore, Karnataka, South India, 1
bengaluru, Karnataka, South India, 1
chennai, Tamil Nadu, South India, 1
hyderabad, Telangana, South India, 1
mysore, Karnataka, South India, 2
mysuru, Karnataka, South India, 2
coimbatore, Tamil Nadu, South India, 2
madurai, Tamil Nadu, South India, 2
kochi, Kerala, South India, 2
cochin, Kerala, South India, 2
trivandrum, Kerala, South India, 2
thiruvananthapuram, Kerala, South India, 2
visakhapatnam, Andhra Pradesh, South India, 2
vijayawada, Andhra Pradesh, South India, 2
tirupati, Andhra Pradesh, South India, 3
mangalore, Karnataka, South India, 2
hubli, Karnataka, South India, 3
salem, Tamil Nadu, South India, 3
tiruchirappalli, Tamil Nadu, South India, 3
kozhikode, Kerala, South India, 3
mumbai, Maharashtra, West India, 1
pune, Maharashtra, West India, 1
ahmedabad, Gujarat, West India, 1
surat, Gujarat, West India, 2
rose, Gujarat, West India, 2
vadodara, Gujarat, West India, 2
rajkot, Gujarat, West India, 2
nagpur, Maharashtra, West India, 2
nashik, Maharashtra, West India, 2
thane, Maharashtra, West India, 2
navi mumbai, Maharashtra, West India, 2
goa, Goa, West India, 3
panaji, Goa, West India, 3
aurangabad, Maharashtra, West India, 2
kolkata, West Bengal, East India, 1
patna, Bihar, East India, 2
ranchi, Jharkhand, East India, 2
bhubaneswar, Odisha, East India, 2
guwahati, Assam, East India, 2
jamshedpur, Jharkhand, East India, 2
cuttack, Odisha, East India, 3
siliguri, West Bengal, East India, 3
imphal, Manipur, East India, 3
shillong, Meghalaya, East India, 3
bhopal, Madhya Pradesh, Central India, 2
indore, Madhya Pradesh, Central India, 2
jabalpur, Madhya Pradesh, Central India, 2
raipur, Chhattisgarh, Central India, 2
gwalior, Madhya Pradesh, Central India, 3
"""

# Name, display name, region, tier of the known countries.
COUNTRIES = """
algeria, Algeria, Africa, 3
american samoa, American Samoa, Oceania, 3
andorra, Andorra, Europe, 1
argentina, Argentina, South America, 2
armenia, Armenia, Europe, 3
australia, Australia, Oceania, 1
austria, Austria, Europe, 1
bahamas, Bahamas, North America, 2
belgium, Belgium, Europe, 1
bosnia and herzegovina, Bosnia and Herzegovina, Europe, 3
brazil, Brazil, South America, 2
canada, Canada, North America, 1
central african republic, Central African Republic, Africa, 3
china, China, Asia, 1
colombia, Colombia, South America, 2
croatia, Croatia, Europe, 2
czech republic, Czech Republic, Europe, 2
denmark, Denmark, Europe, 1
ecuador, Ecuador, South America, 3
egypt, Egypt, Africa, 3
estonia, Estonia, Europe, 2
finland, Finland, Europe, 1
france, France, Europe, 1
germany, Germany, Europe, 1
ghana, Ghana, Africa, 3
gibraltar, Gibraltar, Europe, 1
greece, Greece, Europe, 2
honduras, Honduras, North America, 3
india, India, Asia, 2
indonesia, Indonesia, Asia, 2
iran, Iran, Middle East, 3
iraq, Iraq, Middle East, 3
ireland, Ireland, Europe, 1
israel, Israel, Middle East, 1
italy, Italy, Europe, 1
japan, Japan, Asia, 1
kenya, Kenya, Africa, 3
latvia, Latvia, Europe, 2
lithuania, Lithuania, Europe, 2
luxembourg, Luxembourg, Europe, 1
malaysia, Malaysia, Asia, 2
malta, Malta, Europe, 1
mauritius, Mauritius, Africa, 2
mexico, Mexico, North America, 2
moldova, Moldova, Europe, 3
netherlands, Netherlands, Europe, 1
new zealand, New Zealand, Oceania, 1
nigeria, Nigeria, Africa, 3
pakistan, Pakistan, Asia, 3
philippines, Philippines, Asia, 2
poland, Poland, Europe, 2
portugal, Portugal, Europe, 2
puerto rico, Puerto Rico, North America, 1
qatar, Qatar, Middle East, 1
romania, Romania, Europe, 2
russia, Russia, Europe, 2
saudi arabia, Saudi Arabia, Middle East, 2
singapore, Singapore, Asia, 1
slovenia, Slovenia, Europe, 2
south africa, South Africa, Africa, 2
south korea, South Korea, Asia, 1
spain, Spain, Europe, 1
sweden, Sweden, Europe, 1
switzerland, Switzerland, Europe, 1
thailand, Thailand, Asia, 2
turkey, Turkey, Europe, 2
ukraine, Ukraine, Europe, 3
united arab emirates, United Arab Emirates, Middle East, 1
united kingdom, United Kingdom, Europe, 1
united states, United States, North America, 1
usa, United States, North America, 1
us, United States, North America, 1
uk, United Kingdom, Europe, 1
gb, United Kingdom, Europe, 1
uae, United Arab Emirates, Middle East, 1
vietnam, Vietnam, Asia, 3
chile, Chile, South America, 2
peru, Peru, South America, 3
taiwan, Taiwan, Asia, 1
hong kong, Hong Kong, Asia, 1
"""

# Name parts of geographic columns.
GEO_WORDS = (
    "city", "state", "region", "country", "pincode", "zip", "postal", "location", "address", "area", "district",
    "province", "territory", "town", "village",
)

UNKNOWN = "Unrecognized"


def places(kind: str) -> list[tuple[str, str, str, int]]:
    """(name, state, region, tier) of all known cities or countries."""
    lines = {"city": CITIES, "country": COUNTRIES}[kind].strip().splitlines()
    return [(n, s, r, int(t)) for n, s, r, t in (line.split(", ") for line in lines)]


def dimension(spark: SparkSession, kind: str) -> DataFrame:
    """The places as a frame: under a hundred rows, fixed, safe to broadcast."""
    return spark.createDataFrame(places(kind), "name string, state string, region string, tier int")


def geo_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in GEO_WORDS)]


def place_key(column: str) -> Column:
    return F.lower(strip(F.col(column)))


def match_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column known as countries and as cities."""
    values = df.select(place_key(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    known = {kind: [n for n, *_ in places(kind)] for kind in ("country", "city")}
    return values.agg(*[F.count(F.when(F.col("v").isin(*names), 1)).alias(kind) for kind, names in known.items()])


def choose_kind(df: DataFrame, column: str) -> str:
    """'country' unless more values are known cities. Runs one job."""
    found = match_counts(df, column).first()
    return "country" if found["country"] >= found["city"] else "city"


def enrich(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add geo_state, geo_region and geo_tier; unknown and missing places are "Unrecognized"."""
    known = dimension(df.sparkSession, kind)
    joined = df.join(F.broadcast(known), place_key(column) == F.col("name"), "left")
    return joined.select(
        *[df[c] for c in df.columns],
        F.coalesce("state", F.lit(UNKNOWN)).alias("geo_state"),
        F.coalesce(known["region"], F.lit(UNKNOWN)).alias("geo_region"),
        F.coalesce(F.concat(F.lit("Tier "), F.col("tier")), F.lit(UNKNOWN)).alias("geo_tier"),
    )


def suggestions(df: DataFrame, column: str, kind: str, cutoff: float = 0.6) -> DataFrame:
    """Closest known name for every distinct unknown value that has one (original, suggested).

    Matching runs on distinct values only, spread over all tasks.
    """
    names = [n for n, *_ in places(kind)]
    unknown = (
        df.select(strip(F.col(column)).alias("original"))
        .where((F.col("original") != "") & ~F.lower("original").isin(*names))
        .distinct()
    )
    return unknown.withColumn("suggested", closest(F.col("original"), names, cutoff)).where(
        F.col("suggested").isNotNull()
    )


def correct(df: DataFrame, column: str, kind: str, cutoff: float = 0.6) -> DataFrame:
    """Replace unknown names by their suggestion, for enrichment. Spark picks the join by size."""
    fixes = suggestions(df, column, kind, cutoff).select(F.lower("original").alias("_o"), "suggested").groupBy("_o").agg(
        F.min("suggested").alias("_s")
    )
    joined = df.join(fixes, place_key(column) == F.col("_o"), "left")
    return joined.withColumn(column, F.coalesce("_s", column)).drop("_o", "_s")


def region_breakdown(enriched: DataFrame, metric: str | None = None) -> DataFrame:
    """Rows, percent of all rows and mean of a metric per region, largest first."""
    aggregates = [F.count(F.lit(1)).alias("rows")] + ([F.avg(metric).alias("metric")] if metric else [])
    groups = enriched.groupBy(F.col("geo_region").alias("region")).agg(*aggregates)
    total = groups.agg(F.sum("rows")).scalar()
    return groups.withColumn("pct", F.col("rows") * 100.0 / total).orderBy(F.col("rows").desc(), "region")
