import random

from tests import models
from wordclips.functions import phones as PH
from wordclips.functions import text as TX
from wordclips.operators import lexicon as LX
from wordclips.operators import splice as SP


def lex(spark, **words):
    return spark.createDataFrame([(w, p.split()) for w, p in words.items()], "word string, phones array<string>")


def vocab(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")


def expand(spark, text, known=(), lexicon=None):
    t = spark.createDataFrame([(1, text)], "text_id bigint, text string")
    v = spark.createDataFrame([(w, 1) for w in known] or [("~", 1)], "word string, n bigint")
    lx = lexicon or lex(spark, kilometers="K")
    return [x.word for x in LX.expand_tokens(TX.written_tokens(t), v, lx).orderBy("pos").collect()]


def test_written_forms(spark):
    cases = {
        "$50": "fifty dollars", "50%": "fifty percent", "1,500": "one thousand five hundred", "2.0": "two point zero",
        "3.5l": "three point five litres", "21st": "twenty first", "1980s": "nineteen eighties", "80s": "eighties",
        "4x4": "four by four", "km": "kilometers", "i30": "i thirty", "mk2": "mark two", "50km": "fifty kilometers",
        "rosen's": "rosens", "four-cylinder": "four cylinder", "and/or": "and or", "5l": "five litres", "101": "one hundred and one",
        "km/h": "kilometers per hour", "don't": "dont", "1000001": "one million and one",
    }
    text = " ".join(cases)
    assert " ".join(expand(spark, text)) == " ".join(cases.values())


def test_a_label_the_corpus_holds_wins_unless_numeric_meaning_is_lost(spark):
    assert expand(spark, "v8 80s 2.0 $50", ["v8", "80s", "20", "50"]) == ["v8", "80s", "two", "point", "zero", "fifty", "dollars"]


def test_unstretch(spark):
    v = spark.createDataFrame([("long", 5), ("good", 9), ("god", 2), ("stop", 1), ("soon", 3), ("so", 4)], "word string, n bigint")
    t = spark.createDataFrame([(x,) for x in ("loooong", "goood", "stoppp", "soon", "soo", "yes")], "token string")
    got = {x.token: (x.word, [tuple(m) for m in x.marks]) for x in LX.unstretch(t, v, lex(spark, yes="Y EH S")).collect()}
    assert got == {"loooong": ("long", [(1, 1, 3)]), "goood": ("good", [(1, 2, 1)]), "stoppp": ("stop", []), "soo": ("so", [(1, 1, 1)])}


def test_pronounce_rules_in_order(spark):
    lx = lex(spark, cat="K AE T", dog="D AO G", wish="W IH SH", make="M EY K", want="W AA N T", dont_="X", color="K AH L ER",
             smelly="S M EH L IY", snip="S N IH P", play="P L EY", dumb="D AH M", ass="AE S", five="F AY V", v="V IY", eight="EY T")
    words = ["cats", "dogs", "wishes", "making", "wanted", "colour", "colours", "smelliest", "snipped", "replay", "dumbass", "v8", "caaaat", "zzz"]
    d = spark.createDataFrame([(w,) for w in words], "word string")
    got = {x.word: " ".join(x.phones) for x in LX.pronounce(d, lx).collect()}
    assert got == {"cats": "K AE T S", "dogs": "D AO G Z", "wishes": "W IH SH IH Z", "making": "M EY K IH NG", "wanted": "W AA N T IH D",
                   "colour": "K AH L ER", "colours": "K AH L ER Z", "smelliest": "S M EH L IY AH S T", "snipped": "S N IH P T",
                   "replay": "R IY P L EY", "dumbass": "D AH M AE S", "v8": "V IY EY T", "caaaat": "K AE T"}


def test_guess_takes_known_chunks_then_clusters(spark):
    d = spark.createDataFrame([("nurring",), ("qat",)], "word string")
    got = {x.word: " ".join(x.phones) for x in LX.guess_phones(d, lex(spark, ring="R IH NG")).collect()}
    assert got == {"nurring": "N ER R IH NG", "qat": "K AE T"}


def test_layered_lexicon(spark):
    base, over = lex(spark, zoo="Z UW", mick="M IH K", nug="N AH G"), lex(spark, nug="N UH G")
    rows = spark.createDataFrame([(0, 1, "zoop", "zoo p"), (0, 2, "usb", "=letters"), (0, 3, "micknug", "mick nug"), (0, 4, "bad", "nothing here"),
                                  (1, 1, "mick", "=skip"), (1, 2, "zoop", "z uw b"), (1, 3, "zoop", "what")], "layer int, line bigint, word string, value string")
    got, rejected = LX.load_lexicon(base, over, rows)
    words = {x.word: None if x.phones is None else " ".join(x.phones) for x in got.collect()}
    assert words == {"zoo": "Z UW", "nug": "N UH G", "zoop": "Z UW B", "usb": "Y UW EH S B IY", "micknug": "M IH K N UH G", "mick": None}
    assert {(x.layer, x.word) for x in rejected.collect()} == {(0, "bad"), (1, "zoop")}


def test_plan_costs_match_a_plain_search(spark):
    r = random.Random(3)
    inv = ["K", "AE", "T", "S", "IH"]
    words = {f"w{i}": ([r.choice(inv) for _ in range(r.randrange(1, 5))], r.randrange(1, 15)) for i in range(12)}
    words["the"] = (["T", "AE"], 20)
    targets = {f"t{i}": [r.choice(inv) for _ in range(r.randrange(1, 9))] for i in range(25)}
    w = spark.createDataFrame([(k, p, n) for k, (p, n) in words.items()], "word string, phones array<string>, n bigint")
    t = spark.createDataFrame(list(targets.items()), "word string, phones array<string>")
    plans = {x.target: x for x in SP.splice_plan(t, SP.splice_edges(t, w)).collect()}
    for name, phones in targets.items():
        want = models.cheapest_plan(phones, words, set(PH.FUNCTION_WORDS), set(PH.VOWELS))
        assert (plans[name].cost if name in plans else None) == want
        if want is not None:
            spelt = [p for e in plans[name].pieces for p in words[e.word][0][e.word_pos:e.word_pos + e.j - e.i]]
            assert spelt == phones


def test_modes_are_additive(spark):
    w = spark.createDataFrame([("bit", ["B", "IH", "T"], 2), ("chat", ["CH", "AE", "T"], 2)], "word string, phones array<string>, n bigint")
    t = spark.createDataFrame([("bit", ["B", "IH", "T"]), ("pit", ["P", "IH", "T"]), ("shat", ["SH", "AE", "T"]), ("moo", ["M", "UW"])], "word string, phones array<string>")
    plan = {m: {x.target: (x.cost, x.approx) for x in SP.splice_plan(t, SP.splice_edges(t, w, m)).collect()} for m in ("strict", "loose", "desperate")}
    assert set(plan["strict"]) == {"bit"} and plan["strict"]["bit"] == plan["loose"]["bit"] == plan["desperate"]["bit"]
    assert set(plan["loose"]) == {"bit", "pit", "shat"} and plan["loose"]["pit"] == (10_752, True)
    assert plan["loose"]["shat"][1] is False          # half of CH is a real SH
    assert set(plan["desperate"]) == {"bit", "pit", "shat"}   # moo has no sound at all


def test_downvoted_source_costs_more(spark):
    w = spark.createDataFrame([("big", ["B", "IH", "G"], 2), ("bid", ["B", "IH", "D"], 1)], "word string, phones array<string>, n bigint")
    t = spark.createDataFrame([("bi", ["B", "IH"])], "word string, phones array<string>")
    plain = SP.splice_edges(t, w).where("i = 0 and j = 2").collect()[0]
    bad = spark.createDataFrame([("bi", "big", 3)], "target string, word string, votes bigint")
    voted = SP.splice_edges(t, w, disliked=bad).where("i = 0 and j = 2").collect()[0]
    assert (plain.word, voted.word) == ("big", "bid")


def test_phone_sources_rank_fewest_cuts_first(spark):
    words = "big:B IH G|catch:K AE CH|bit:B IH T|itch:IH CH|rich:R IH CH|beach:B IY CH|shell:SH EH L|the:DH AH"
    w = spark.createDataFrame([(x.split(":")[0], x.split(":")[1].split(), 2) for x in words.split("|")], "word string, phones array<string>, n bigint")
    longest = w.selectExpr("word", "300L as longest_ms")
    g = spark.createDataFrame([("IH CH",)], "run string")
    got = [(x.word, x.cuts) for x in SP.phone_sources(g, w, longest).orderBy("rank").collect()]
    assert got == [("itch", 0), ("rich", 1)]


def test_recipe_prefers_its_sources_and_falls_back(spark):
    w = spark.createDataFrame([("big", ["B", "IH", "G"], 1), ("itch", ["IH", "CH"], 1), ("rich", ["R", "IH", "CH"], 1)], "word string, phones array<string>, n bigint")
    t = spark.createDataFrame([("bitch", ["B", "IH", "CH"])], "word string, phones array<string>")
    takes = spark.createDataFrame([("big", 5, 100, 400)], "word string, clip_id bigint, start_ms bigint, end_ms bigint")
    none = spark.createDataFrame([], "phrase string, clip_id bigint")

    def run(groups):
        r = spark.createDataFrame([("bitch", groups)], f"word string, groups {SP.RECIPE}")
        return {(x.k, x.way, x.source, x.clip_id) for x in SP.apply_recipes(r, t, w, takes, none).collect()}

    assert run([(["B"], ["big"], 5, 110, 200), (["IH", "CH"], ["rich"], None, None, None)]) == {(0, 0, "big", 5), (1, 1, "rich", None)}
    assert run([(["B"], ["big"], 5, 50, 200), (["IH", "CH"], [], None, None, None)]) == {(0, 1, "big", None), (1, 2, "itch", None)}
    assert run([(["B"], [], None, None, None), (["IH"], [], None, None, None)]) == set()
