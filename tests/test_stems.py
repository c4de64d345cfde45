"""Stems against published pairs, and the SQL made of the same tables."""

import random

import pytest

from corpusgraph.functions import stems
from tests.duck import assert_same, connect

# Words and stems as the published algorithms give them.
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators
conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled
kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights
knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot generate generat generously generous communication communic arsenal arsenal happy happi by by
say say cries cri ties tie tied tie gas gas this this gaps gap kiwis kiwi hoping hope hopped hop luxuriated luxuri relational relat conditional condit
skies sky dying die sky sky news news innings inning exceeds exceed feed feed agreed agre plastered plaster bled bled fizzed fizz filing file""".split()
PORTUGUESE = """boa boa boainain boainain boas boas bôas bôas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag
bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc bocadinho bocadinh
bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body boeing boeing boem boem boemia boem boêmio boêmi
quiabos quiab quicaram quic quickly quickly quieto quiet quietos quiet quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb
quilométricas quilométr quilométricos quilométr quilômetro quilômetr quilômetros quilômetr quilos quil químico químic químicos químic quimioterapia
quimioterap quimono quimon quincas quinc quinhão quinhã quinhentos quinhent quinn quinn quino quin quinta quint quintal quintal quintana quintan
quintão quintã quinto quint quintos quint quiosque quiosqu quis quis quiser quis quisera quis quisermos quis quota quot""".split()


@pytest.mark.parametrize(("lang", "pairs"), [("en", ENGLISH), ("pt", PORTUGUESE), ("pt-BR", PORTUGUESE)])
def test_published_stems(spark, lang, pairs):
    rows = list(zip(pairs[::2], pairs[1::2], strict=True))
    frame = spark.createDataFrame([*rows, (None, None)], "word string, wanted string")
    found = frame.select("word", "wanted", stems.stem("word", lang).alias("stem")).collect()
    assert [(r.word, r.wanted, r.stem) for r in found if r.wanted != r.stem] == []


@pytest.mark.parametrize("lang", ["en", "pt"])
def test_sql_of_the_same_tables(spark, lang):
    rng = random.Random(8)
    rules = [r.suffix for s in stems.LANGUAGES[lang].steps for r in s.rules]
    made = ["".join(rng.choice("aeioubcdstlnrgyéã") for _ in range(rng.randrange(6))) + rng.choice(rules) for _ in range(3000)]
    frame = spark.createDataFrame([(w,) for w in {*made, *ENGLISH, *PORTUGUESE}], "word string")
    sql = f"SELECT word, stem FROM ({stems.stem_sql('words', 'word', lang)})"
    connection = connect(None)
    connection.register("words", frame.toPandas())
    assert_same(frame.select("word", stems.stem("word", lang).alias("stem")), sql, connection)
