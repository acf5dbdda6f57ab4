"""Porter stemmer expressions on words from the published algorithm's examples."""

from sift.functions.stem import stem_column

GOLDEN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
    "hopefulness": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "generalizations": "gener", "oscillators": "oscil", "is": "is", "a": "a",
}


def test_porter_golden(spark):
    df = spark.createDataFrame([(w,) for w in GOLDEN], "w string")
    got = {r.w: r.s for r in stem_column(df, "w", "s").collect()}
    bad = {w: (got[w], GOLDEN[w]) for w in GOLDEN if got[w] != GOLDEN[w]}
    assert not bad, bad
