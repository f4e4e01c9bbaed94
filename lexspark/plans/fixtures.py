"""Small inputs of queries that the tables hold nothing for: dictionaries, model texts, a treebank."""

USER_DICTIONARY = "晴雨表\n 海风号 2.0\n一同 100.0\n\n海风号 3.5\n and 4.25\nthe 6.0\n"
COUNTS_DICTIONARY = "alpha 3\nbeta 1\ngamma 2\nbeta 7\n"
TAGGED_CORPUS = "小_JJ 猫_NN 睡_VV 。_PU\nsnake_case_NN bare 3_CD\n"
PERCEPTRON_TEXT = "B f1 0.5\nA f1 -1.25\nA f2 2\nA f1 1.5\n"
CRF_TEXT = "u:小\t*\tB\t1.5\nu:小\t*\tS\t-0.5\nu:猫\t*\tE\t1.25\nb\tB\tE\t0.75\nb\tS\tS\t0.25\n"
#: Sentences of word, tag, head and label.
TREEBANK = """the DT 2 NMOD
cat NN 3 SBJ
sleeps NR 0 ROOT
. PU 3 P

a DT 3 NMOD
small NN 3 NMOD
dog NN 4 SBJ
barks NN 0 ROOT
at DT 4 VMOD
7 CD 7 NMOD
birds NR 5 PMOD
. PU 4 P

it DT 2 SBJ
rained NN 0 ROOT
, PU 2 P
and DT 2 COORD
we DT 6 SBJ
left NR 4 CONJ
. PU 2 P

7 CD 2 NMOD
birds NN 3 SBJ
flew NN 0 ROOT
to DT 3 VMOD
the DT 6 NMOD
sea NR 4 PMOD
. PU 3 P
"""
#: Predictions for the treebank: sentence, idx, head, label.
PREDICTED = ((0, 1, 2, "NMOD"), (0, 2, 3, "SBJ"), (0, 3, 0, "ROOT"), (0, 4, 2, "P"), (1, 1, 3, "NMOD"), (1, 2, 3, "SBJ"), (1, 3, 4, "SBJ"), (1, 4, 0, "ROOT"), (1, 5, 3, "VMOD"), (1, 6, 7, "NMOD"), (1, 7, 5, "PMOD"), (1, 8, 4, "P"), (2, 1, 2, "SBJ"), (2, 2, 0, "ROOT"), (2, 4, 2, "CONJ"))
#: Words of two sentences with number of tokens and word type, and properties of characters.
OOV_WORDS = ((0, 0, "小", 1, 0), (0, 1, "海风", 2, 0), (0, 2, "号", 1, 0), (0, 3, "驶", 1, 0), (0, 4, "abc", 1, 1), (0, 5, "的", 1, 0), (0, 6, "帆", 1, 0), (1, 0, "帆", 1, 0), (1, 1, "7", 1, 2), (1, 2, "号", 1, 0), (1, 3, "阿", 1, 0), (1, 4, "明天", 2, 0), (1, 5, "的", 1, 0))
OOV_PROPERTIES = (("阿", 1), ("号", 2), ("的", 3))
SEGMENT_CRF = (("u:小", None, "B", 2.0), ("u:猫", None, "E", 2.0), ("u:帆", None, "S", 1.0), ("b", "B", "E", 0.5), ("b", "S", "S", 0.25), ("b", "S", "B", 0.25), ("b", "B", "B1", -1.0), ("b", "B1", "B2", -1.0), ("b", "B2", "M", -1.0), ("b", "B1", "E", 0.1), ("b", "B2", "E", 0.1), ("b", "M", "E", 0.1), ("b", "E", "S", 0.2))
SEGMENT_TEMPLATES = ("u:%x[0,0]", "b")
#: Templates of the tag model over surface features, and of the features that are listed.
TAG_TEMPLATES = ("u0:%x[0,0]", "u1:%x[0,1]/%x[0,3]", "u2:%x[0,2]", "u3:%x[-1,0]", "u4:%x[1,0]", "b")
LISTED_TEMPLATES = ("u00:%x[0,0]", "u01:%x[-1,0]/%x[0,0]", "u02:%x[2,0]", "u03:%x[-2,0]")
PREFIXES = ("th", "de", "a", "zzzz", "un")
CLASSIFIER = (("t=6", "word", 1.0), ("t=6", "mark", -0.5), ("t=7", "mark", 2.0), ("t=9", "mark", 1.5), ("len=1", "mark", 0.25), ("len=2", "short", 1.25), ("len=3", "short", 0.75), ("w=the", "word", 1.5), ("w=de", "word", 0.5), ("t=1", "space", 3.0), ("t=3", "space", 3.0))
GBK_WORDS = (("我的猫", "CED2B5C4C3A8"), ("abc", "616263"), ("", ""), ("a😀b", "6162"))
#: Pieces of the generated texts of mixed script, and how many texts there are.
CHINESE_PIECES = ("小", "猫", "帆", "小猫", "海风号", "晴雨表", "一同", "阿明", "的", "号", "7", "abc", "。", "驶", "明天", "，", "the ", "小小", "帆船", "水", "阿", "3.5", "喜欢")
CHINESE_TEXTS = 4_000
