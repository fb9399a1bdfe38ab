"""Points of a performance: a quadratic of the mark by gender, event and indoor or outdoor, within plausible bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gender, event, place (any: one curve for both), and a, b, c of a*x^2 + b*x + c; x in seconds or metres.
COEFFICIENTS = """
M 60m any 68.62032200155772 -1468.376079820242 7854.923996115336
M 200m indoor 5.0428984333116205 -363.0051678271411 6532.672628951492
M 200m outdoor 5.083329625804254 -360.8260380705033 6403.154333221377
M 400m indoor 0.9810285010226494 -158.13093544779986 6372.245446830289
M 400m outdoor 1.0210130425695638 -161.3092238081408 6371.289298935095
M 600m indoor 0.3899861152610953 -102.17335025475768 6692.146447579609
M 600m outdoor 0.3856992283143512 -99.89240864996827 6467.788691627793
M 800m indoor 0.19739256108073278 -72.63927638712084 6682.6879602972185
M 800m outdoor 0.1980049254166545 -72.07136038821409 6558.28160300618
M 1000m indoor 0.11389778654137217 -54.670029751952825 6560.289996561711
M 1000m outdoor 0.11229987246056083 -53.34129687676432 6334.142779359594
M 1500m indoor 0.041999988506264074 -32.423575703958704 6257.669581143418
M 1500m outdoor 0.04065992529984008 -31.307736299477256 6026.662254345021
M mile indoor 0.036900007414912395 -30.626657725760197 6354.958031052956
M mile outdoor 0.035099677603458446 -29.132456259137143 6044.924547011615
M 3000m indoor 0.00832191917227365 -13.980775520668885 5871.90250552597
M 3000m outdoor 0.008150049932713843 -13.691983542337312 5750.59246378555
M 5000m indoor 0.002900003148620267 -8.351976844926412 6013.40053571912
M 5000m outdoor 0.002777997945427213 -8.000608112196687 5760.418712362531
M 60mh any 23.916231718984818 -698.1937268964539 5095.479315056291
M hj any 32.14570816360356 745.3746826150164 -705.259733494051
M pv any 3.0457199208785823 239.612026696057 -280.5412229935755
M lj any 1.931092872960562 186.73134733641928 -479.70640445759636
M tj any 0.4603666024030417 90.96978768056579 -514.9946082626993
M sp any 0.04234614355526389 57.99966265925241 -55.823610246186945
M wt any 0.0028444950947790204 15.081627308136717 -21.68901198504136
F 60m any 24.91177544269476 -697.4127036580539 4880.84062414919
F 200m indoor 1.9617476310046413 -186.35304547847045 4425.540362004947
F 200m outdoor 2.2422237149162925 -204.01464451534775 4640.727341804304
F 400m indoor 0.32239778088712256 -72.2140857003651 4043.8163995789655
F 400m outdoor 0.3350059758445596 -73.6974469594461 4053.1545244171575
F 600m indoor 0.10630096102938147 -40.4675585171226 3851.3911703779886
F 600m outdoor 0.1290024817337887 -46.439367295225566 4179.4139537496085
F 800m indoor 0.05719995663858857 -30.201001015322618 3986.4574604244845
F 800m outdoor 0.06879989341997295 -34.399261916380055 4299.822125108796
F 1000m indoor 0.034730273669098644 -23.643965410011788 4024.137096635415
F 1000m outdoor 0.038199708533426247 -25.211487793783817 4159.840558573429
F 1500m indoor 0.013649954143477805 -14.741826462372728 3980.259331609617
F 1500m outdoor 0.01339999627048627 -14.471861176560651 3907.3655835949467
F mile indoor 0.011540015186639607 -13.513232952897397 3955.963356088527
F mile outdoor 0.011649998601839462 -13.513881163102496 3918.992004961794
F 3000m indoor 0.002590000537161685 -6.215973858107134 3729.5683351015323
F 3000m outdoor 0.0025389974609562604 -6.09357042856243 3656.127933666052
F 5000m indoor 0.00082499992965758 -3.464991324219369 3638.23229190876
F 5000m outdoor 0.0008079992470730324 -3.3935897885437782 3563.2616780022654
F 60mh any 11.16828188896136 -406.39148481091615 3696.9522386075114
F hj any 39.557908744493034 831.3655724464043 -601.5063267494843
F pv any 3.9325797501069246 275.48968329946365 -205.1216924619548
F lj any 1.958114032649064 193.69548254413166 -233.98988652729167
F tj any 0.4296645887350792 90.3430418780863 -231.6675825305283
F sp any 0.046214387641356325 60.75503111383068 -25.931941888942674
F wt any 0.0030967239667614166 15.730166876520684 -22.699498543297523
"""

#: Gender, event, kind of bound and bound: the slowest time, or the shortest distance, that is taken for real.
BOUNDS = """
M 60m max 12
M 200m max 35
M 400m max 75
M 600m max 120
M 800m max 180
M 1000m max 240
M 1500m max 330
M mile max 360
M 3000m max 720
M 5000m max 1200
M 60mh max 15
F 60m max 13
F 200m max 40
F 400m max 85
F 600m max 140
F 800m max 200
F 1000m max 270
F 1500m max 380
F mile max 420
F 3000m max 840
F 5000m max 1380
F 60mh max 18
M hj min 1.0
F hj min 1.0
M pv min 2.0
F pv min 2.0
M lj min 3.0
F lj min 3.0
M tj min 8.0
F tj min 7.0
M sp min 5.0
F sp min 5.0
M wt min 5.0
F wt min 5.0
"""
MOST_POINTS = 1400


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def curves() -> list[tuple[str, str, bool, float, float, float, float | None, float | None]]:
    """gender, event, indoor, a, b, c, most, least: a row for indoors and one for outdoors."""
    bounds = {(g, e, kind): float(x) for g, e, kind, x in _rows(BOUNDS)}
    out = []
    for g, e, where, a, b, c in _rows(COEFFICIENTS):
        for indoor in (True, False):
            if where in ("any", "indoor" if indoor else "outdoor"):
                out.append((g, e, indoor, float(a), float(b), float(c), bounds.get((g, e, "max")), bounds.get((g, e, "min"))))
    return out


#: Event of a coefficients file, and the fastest and slowest time in seconds that is taken for real.
TIMES = """
60m 6 12
100m 9 18
200m 19 35
300m 30 55
400m 43 75
500m 58 100
600m 72 120
800m 100 180
1000m 130 240
1500m 200 360
Mile 220 400
3000m 450 720
5000m 750 1200
10000m 1560 2400
55mH 6.5 12
60mH 7 12
100mH 11 20
110mH 12 22
400mH 45 90
"""
#: Keys of the genders in a coefficients file, and the ending of an event's short-track curve.
FILE_GENDERS, SHORT_TRACK = {"men": "M", "women": "F"}, " sh"


def file_curves(spark: SparkSession, path: str) -> DataFrame:
    """gender, event, short, a, b, c of a JSON file of gender -> event -> [a, b, c]; short: the curve is for short tracks. Entries that aren't three numbers are left out."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<double>>>")).alias("g", "events"))
    each = read.select("g", F.explode("events").alias("name", "k")).where("size(k) = 3 AND NOT exists(k, x -> x IS NULL)")
    gender = F.coalesce(*[F.when(F.col("g") == k, v) for k, v in FILE_GENDERS.items()])
    short = F.endswith("name", F.lit(SHORT_TRACK))
    return each.select(gender.alias("gender"), F.when(short, F.regexp_replace("name", f"{SHORT_TRACK}$", "")).otherwise(F.col("name")).alias("event"), short.alias("short"), F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("c")).where("gender IS NOT NULL")


def scored_by_file(spark: SparkSession, marks: DataFrame, curves: DataFrame) -> DataFrame:
    """marks (gender, event, indoor, x and more) with points by file_curves: indoors the short-track curve where there is one. Null without a curve, or where a time can't be real."""
    times = spark.createDataFrame([(e, float(a), float(b)) for e, a, b in _rows(TIMES)], "event string, fastest double, slowest double")
    pick = lambda short, name: curves.where(F.col("short") == short).select("gender", "event", F.struct("a", "b", "c").alias(name))
    met = marks.join(pick(True, "__s"), ["gender", "event"], "left").join(pick(False, "__l"), ["gender", "event"], "left").join(F.broadcast(times), "event", "left")  # under 20 rows
    k = F.coalesce(F.when(F.col("indoor"), F.col("__s")), F.col("__l"))
    x = F.col("x")
    points = F.greatest(F.lit(0), F.round(k["a"] * x * x + k["b"] * x + k["c"]).cast("int"))
    real = F.coalesce((x >= F.col("fastest")) & (x <= F.col("slowest")), F.lit(True))
    return met.withColumn("points", F.when(k.isNotNull() & x.isNotNull() & real, points)).drop("__s", "__l", "fastest", "slowest")


def scored(spark: SparkSession, marks: DataFrame) -> DataFrame:
    """marks (gender, event, indoor, x and more) with points; null where no curve applies, the mark is out of bounds, or the points are not in (0, 1400]."""
    table = spark.createDataFrame(curves(), "gender string, event string, indoor boolean, a double, b double, c double, most double, least double")
    found = marks.join(F.broadcast(table), ["gender", "event", "indoor"], "left")  # under 200 rows
    points = F.greatest(F.lit(0), F.round(F.col("a") * F.col("x") * F.col("x") + F.col("b") * F.col("x") + F.col("c")).cast("int"))
    sound = F.coalesce(F.col("x") <= F.col("most"), F.lit(True)) & F.coalesce(F.col("x") >= F.col("least"), F.lit(True)) & (points > 0) & (points <= MOST_POINTS)
    return found.withColumn("points", F.when(F.col("a").isNotNull() & sound, points)).drop("a", "b", "c", "most", "least")
