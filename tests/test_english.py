"""Stems of words whose stems are published with the stemmer, and of awkward ones."""

from keepsake.functions.english import stems
from keepsake.schema import STOP_WORDS

KNOWN = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist",
    "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist",
    "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol",
    "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consoling": "consol",
    "consols": "consol", "consonant": "conson", "consort": "consort", "consorted": "consort", "conspicuous": "conspicu",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel",
    "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife",
    "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit",
    "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker",
    "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
    "captured": "captur", "capture": "captur", "captures": "captur", "capturing": "captur", "happy": "happi", "cry": "cri", "by": "by",
    "say": "say", "hopping": "hop", "hoping": "hope", "falling": "fall", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap",
    "kiwis": "kiwi", "this": "this", "relational": "relat", "conditional": "condit", "rational": "ration", "valency": "valenc",
    "digitizer": "digit", "conformably": "conform", "radically": "radic", "differently": "differ", "vilely": "vile",
    "analogously": "analog", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formality": "formal", "sensitivity": "sensit", "sensibility": "sensibl", "triplicate": "triplic", "formative": "format",
    "formalize": "formal", "electricity": "electr", "electrical": "electr", "goodness": "good", "allowance": "allow", "inference": "infer",
    "replacement": "replac", "adjustment": "adjust", "adoption": "adopt", "luxuriated": "luxuri", "generously": "generous",
    "generate": "generat", "communism": "communism", "arsenal": "arsenal", "skies": "sky", "dying": "die", "news": "news", "proceeds": "proceed",
    "succeeded": "succeed", "inning": "inning", "innings": "inning", "early": "earli", "youth": "youth", "enjoy": "enjoy", "a": "a", "is": "is",
    "controlling": "control", "rolling": "roll", "rate": "rate", "bed": "bed", "bead": "bead", "beds": "bed", "agreed": "agre", "feed": "feed",
    "2024": "2024", "été": "été", "": "",
}


def test_published_stems(spark):
    df = stems(spark.createDataFrame([(w, 1) for w in KNOWN], "term string, n int"))
    assert df.columns == ["term", "n", "stem"]
    got = {r["term"]: r["stem"] for r in df.collect()}
    assert {w: s for w, s in got.items() if s != KNOWN[w]} == {}
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) == 127


def test_no_word(spark):
    assert [tuple(r) for r in stems(spark.createDataFrame([(None,)], "term string")).collect()] == [(None, None)]
