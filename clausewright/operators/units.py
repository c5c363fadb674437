"""Quantities recorded in different units.

Method: numbers with a neighbouring unit spelling are taken from the texts by
JVM regular expressions; the distinct unit spellings are mapped to known
units through an inverted index of character n-grams, verified by a weighted
edit distance in which characters that scanners confuse are cheap; the
resulting alias dictionary is joined to all rows.

Defined results: null and empty texts give no rows; a range, an overall size
and a dual rating give one row per number, all in the unit stated last unless
a number has its own; percentages and tolerances (numbers after a plus-minus
sign) give none; numbers without a known unit give none; repeated rows and
repeated statements give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.edit import weighted_edit_distance
from clausewright.session import join_checked

# Units, their quantity, factor to the common unit and offset, and spellings.
UNITS: list[tuple[str, str, float, float, list[str]]] = [
    ("V", "voltage", 1.0, 0.0, ["V", "volt", "volts", "Vdc", "Vac", "V DC", "V AC", "VDC", "VAC"]),
    ("mV", "voltage", 0.001, 0.0, ["mV", "millivolt", "millivolts"]),
    ("kV", "voltage", 1000.0, 0.0, ["kV", "KV", "kilovolt", "kilovolts"]),
    ("A", "current", 1.0, 0.0, ["A", "amp", "amps", "ampere", "amperes"]),
    ("mA", "current", 0.001, 0.0, ["mA", "milliamp", "milliamps", "milliampere", "milliamperes"]),
    ("kA", "current", 1000.0, 0.0, ["kA", "kiloamp", "kiloamps", "kiloampere", "kiloamperes"]),
    ("mm", "length", 1.0, 0.0, ["mm", "millimetre", "millimetres", "millimeter", "millimeters"]),
    ("cm", "length", 10.0, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
    ("m", "length", 1000.0, 0.0, ["m", "metre", "metres", "meter", "meters"]),
    ("km", "length", 1000000.0, 0.0, ["km", "kilometre", "kilometres", "kilometer", "kilometers"]),
    ("in", "length", 25.4, 0.0, ["in", "inch", "inches", '"', "″", "”"]),
    ("ft", "length", 304.8, 0.0, ["ft", "foot", "feet"]),
    ("kg", "mass", 1.0, 0.0, ["kg", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"]),
    ("g", "mass", 0.001, 0.0, ["g", "gram", "grams", "gramme", "grammes"]),
    ("t", "mass", 1000.0, 0.0, ["t", "tonne", "tonnes"]),
    ("lb", "mass", 0.45359237, 0.0, ["lb", "lbs", "pound", "pounds"]),
    ("C", "temperature", 1.0, 0.0, ["°C", "℃", "º C", "° C", "ºC", "deg C", "degC", "degree Celsius", "degrees Celsius", "degrees C", "Celsius"]),
    ("F", "temperature", 0.5555555555555556, -32.0, ["°F", "℉", "° F", "ºF", "deg F", "degF", "degree Fahrenheit", "degrees Fahrenheit", "degrees F", "Fahrenheit"]),
    ("K", "temperature", 1.0, -273.15, ["K", "kelvin", "kelvins"]),
    ("ms", "duration", 0.001, 0.0, ["ms", "msec", "millisecond", "milliseconds"]),
    ("s", "duration", 1.0, 0.0, ["s", "sec", "secs", "second", "seconds"]),
    ("min", "duration", 60.0, 0.0, ["min", "mins", "minute", "minutes"]),
    ("h", "duration", 3600.0, 0.0, ["h", "hr", "hrs", "hour", "hours"]),
    ("d", "duration", 86400.0, 0.0, ["d", "day", "days"]),
    ("week", "duration", 604800.0, 0.0, ["week", "weeks"]),
]
# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

_WORDS = [*ONES, *TENS, "hundred"]
_SIGN = r"(?:[-−–+]|minus |plus )?"
_DIGITS = r"(?:\d{1,3}(?:[ \u00a0\u202f'’]\d{3})+(?![\d])(?:[.,]\d+)?|\d+(?:[.,]\d+)*)"
NUMBER = rf"{_SIGN}{_DIGITS}"
_SPELLED = rf"(?:(?:{'|'.join(TENS)})(?:[- ](?:{'|'.join(ONES[1:10])}))?|(?:{'|'.join(ONES)})|(?:one |a )?hundred)"
#: A spelling after a number: a sign, a degree sign with its letter, or one or two words.
_UNIT = r"""(?:["″”]|℃|℉|[°º] ?[CFK]\b|(?:degrees?|deg)\b\.? ?\p{L}[\p{L}\p{N}|!@]*|[\p{L}|!@][\p{L}\p{N}|!@]*(?: ?(?:DC|AC)\b)?)"""
#: Numbers that share a unit: ranges, sizes, dual ratings.
_LINK = r"(?: ?(?:[x×/*]|\.\.\.?|…|to|and|or|by|bis) ?| ?[-–] ?)"
_BEFORE = r"(?<![\p{L}\p{N}.,_#/±-])(?<![±≤] ?)(?<!\+/- ?)"
AFTER = rf"""{_BEFORE}(?:{NUMBER}(?:{_LINK}{NUMBER}){{0,3}}[ \u00a0-]?{_UNIT}|\b(?i:{_SPELLED}) {_UNIT})(?![-\p{{L}}\p{{N}}])"""
AHEAD = rf"""(?:\bin {_UNIT} ?[:=] ?|\[{_UNIT}\] ?|\({_UNIT}\) ?[:=] ?){NUMBER}(?![\p{{L}}\p{{N}}])"""
#: Names before a number that make it a designation.
NAMED = r"(?i:\b(?:item|items|slot|slots|clause|clauses|section|step|no|nr|cat|category|class|drawing|annex|page|type|part|table|figure|fig|revision|rev|clarification|version)\.? ?)"


def quantity_phrases(text: Column) -> Column:
    """array<string> of the number phrases with a unit beside them, white space collapsed, designations left out."""
    # a mark that closes a quotation is no inch
    open_ = F.when(F.contains(text, F.lit("“")), F.regexp_replace(text, "“([^“”]*)”", "“$1“")).otherwise(text)
    flat = F.regexp_replace(open_, r"(\p{L}{2})[-\u2010\u2011\u00ad\u00ac][ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")
    flat = F.regexp_replace(flat, r"(?U)\s+", " ")
    kept = F.regexp_replace(flat, rf"{NAMED}\d[\w.,-]*", "§")
    after = F.regexp_extract_all(kept, F.lit(AFTER), 0)
    ahead = F.regexp_extract_all(kept, F.lit(AHEAD), 0)
    return F.concat(after, ahead)


def _value(number: Column) -> Column:
    """The double of a written number: signs in any form, thousands marks, decimal comma or point."""
    n = F.regexp_replace(F.regexp_replace(F.lower(number), r"^(minus |−|–|-)", "-"), r"^(plus |\+)", "")
    n = F.regexp_replace(n, r"[ \u00a0\u202f'’]", "")
    both = n.rlike(r",.*\.|\..*,")
    last_comma = n.rlike(r",\d+$")
    n = (
        F.when(both & last_comma, F.regexp_replace(F.regexp_replace(n, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(n, ",", ""))
        .when(n.rlike(r"^-?[1-9]\d{0,2}(,\d{3})+$"), F.regexp_replace(n, ",", ""))
        .when(n.rlike(r"^-?\d{1,3}(\.\d{3}){2,}$"), F.regexp_replace(n, r"\.", ""))
        .otherwise(F.regexp_replace(n, ",", "."))
    )
    return n.try_cast("double")


def _word_value(word: Column) -> Column:
    w = F.lower(word)
    table = {w_: i for i, w_ in enumerate(ONES)} | {w_: 20 + 10 * i for i, w_ in enumerate(TENS)} | {"hundred": 100, "one hundred": 100, "a hundred": 100}
    table |= {f"{t}{sep}{o}": 20 + 10 * i + 1 + j for i, t in enumerate(TENS) for j, o in enumerate(ONES[1:10]) for sep in "- "}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, w).cast("double")


def stated_numbers(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep + (spelling, value): one row per number of a phrase, with the spelling of its unit as written."""
    p = df.select(*keep, F.explode(F.array_distinct(quantity_phrases(F.col(text)))).alias("__p"))
    ahead = F.col("__p").rlike(rf"^(?:in |\[|\().*?{NUMBER}$") & F.col("__p").rlike(r"[:=\])] ?[-−–+mp\d]")
    words = F.regexp_extract("__p", rf"^(?i)({_SPELLED}) ", 1)
    spelling_ahead = F.regexp_extract("__p", rf"^(?:in |\[|\()({_UNIT})", 1)
    spelling_after = F.regexp_extract("__p", rf"^(?:{NUMBER}(?:{_LINK}{NUMBER}){{0,3}}[ \u00a0-]?|(?i:{_SPELLED}) )({_UNIT})$", 1)
    head = F.regexp_extract("__p", rf"^({NUMBER}(?:{_LINK}{NUMBER}){{0,3}})", 1)
    tail = F.regexp_extract("__p", rf"({NUMBER})$", 1)
    numbers = F.regexp_extract_all(F.regexp_replace(head, rf"(\d)[-–](\d)", "$1 to $2"), F.lit(NUMBER), 0)
    q = p.select(
        *keep,
        F.when(ahead, spelling_ahead).otherwise(spelling_after).alias("spelling"),
        F.when(ahead, F.array(_value(tail))).when(words != "", F.array(_word_value(words))).otherwise(F.transform(numbers, _value)).alias("__v"),
        ((words != "") & ~ahead).alias("__w"),
    )
    q = q.where("spelling != '' and not (__w and length(spelling) < 3 and spelling not in ('ms','kV','kA','mA','mV','kg','mm','cm','km'))")
    return q.select(*keep, "spelling", F.explode("__v").alias("value")).where("value is not null")


def alias_dictionary(spellings: DataFrame, spark: SparkSession, q: int = 2, max_cost: float = 0.25) -> DataFrame:
    """(spelling, unit, quantity, factor, offset): every spelling that is a unit's, exactly or by small scanning errors.

    spellings: (spelling), distinct.  Exact spellings match at once (case
    matters for signs of up to three characters).  Longer ones that differ are
    joined to the known spellings by shared character n-grams and verified by
    the weighted edit distance, at most max_cost per character; the cheapest
    unit wins, ties by name.
    """
    known = spark.createDataFrame([(s, u, n, f, o) for u, n, f, o, names in UNITS for s in names], "known string, unit string, quantity string, factor double, offset double")
    s = spellings.withColumn("flat", F.trim(F.regexp_replace("spelling", r"(?U)[.\s]+", " ")))
    s = s.withColumn("folded", F.when(F.length("flat") > 3, F.lower("flat")).otherwise(F.col("flat")))
    k = known.withColumn("folded", F.when(F.length("known") > 3, F.lower("known")).otherwise(F.col("known")))
    exact = s.join(F.broadcast(k), "folded").select("spelling", "unit", "quantity", "factor", "offset").dropDuplicates(["spelling"])
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(F.concat(F.lit("^"), c, F.lit("$"))) - (q - 1)), lambda i: F.substr(F.concat(F.lit("^"), c, F.lit("$")), i, F.lit(q))))
    rest = s.join(exact.select("spelling"), "spelling", "left_anti").where(F.length("folded").between(4, 40))
    left = rest.select("spelling", "folded", F.explode(grams(F.col("folded"))).alias("g"))
    right = k.where(F.length("folded") > 3).select(F.col("folded").alias("target"), "unit", "quantity", "factor", "offset", F.explode(grams(F.col("folded"))).alias("g"))
    cand = left.join(F.broadcast(right), "g").groupBy("spelling", "folded", "target", "unit", "quantity", "factor", "offset").agg(F.count(F.lit(1)).alias("shared"))
    cand = cand.where((F.abs(F.length("folded") - F.length("target")) <= 2) & (F.col("shared") * 3 >= F.length("target") - 1))
    cost = cand.withColumn("cost", weighted_edit_distance(F.col("folded"), F.col("target"))).where(F.col("cost") <= F.length("target") * max_cost * 0.5)
    best = cost.groupBy("spelling").agg(F.min_by(F.struct("unit", "quantity", "factor", "offset"), F.struct("cost", "unit")).alias("b")).select("spelling", "b.*")
    return exact.unionByName(best)


def convert_quantities(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep + (quantity, unit, value, common_value): every stated quantity in the common unit of its kind."""
    from clausewright.session import cut

    stated = cut(stated_numbers(df, text, keep), "quantities")
    aliases = cut(alias_dictionary(stated.select("spelling").distinct(), df.sparkSession), "aliases")
    j = join_checked(stated, aliases, ["spelling"], "inner")
    return j.select(*keep, "quantity", "unit", "value", ((F.col("value") + F.col("offset")) * F.col("factor")).alias("common_value"))
