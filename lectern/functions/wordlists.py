"""Word lists and maps that results depend on."""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(",") if w.strip()]


# The lists below are part of the features' definitions.
HEDGES = _words("""may, might, could, possibly, perhaps, probably, likely, appears, seems, suggests, indicates, tentatively,
presumably, arguably, approximately, generally, often, sometimes, tend, tends, tended, appear, suggest, indicate, assume,
assumes, assumed, appear to, seem to, likely to, possible, potential, potentially, conceivably, loosely, roughly""")
HEDGE_PHRASES = _words("appear to, seem to, likely to, for example, for instance")
BOOSTERS = _words("""clearly, obviously, undoubtedly, certainly, definitely, demonstrates, demonstrate, proves, prove, establishes,
establish, confirms, confirm, shows, always, never, absolutely, conclusively, evidently, indeed, strongly, unambiguously,
fundamentally, necessarily, undeniably""")
CONNECTORS = _words("""however, therefore, thus, hence, consequently, nevertheless, furthermore, moreover, additionally, also,
besides, likewise, similarly, conversely, alternatively, subsequently, finally, first, second, third, firstly, secondly, thirdly,
lastly, meanwhile, nonetheless, instead, otherwise, accordingly, for example, for instance, in contrast, in addition,
in conclusion, in summary, as a result, on the other hand, on the contrary""")
SELF_MENTIONS = _words("we, our, us, i, my, me, myself, ourselves")
STOPWORDS = _words("""the, a, an, is, are, was, were, be, been, being, have, has, had, do, does, did, will, would, could, should,
may, might, shall, can, of, in, to, for, with, on, at, by, from, and, or, but, not, it, its, this, that, these, those, as, if, so,
than, then, when, where, which, who, what, how, all, more, most""")
POSITIVES = _words("""good, great, excellent, amazing, wonderful, fantastic, best, better, love, loved, perfect, perfectly, happy,
glad, pleased, delighted, satisfied, enjoy, enjoyed, enjoyable, superb, outstanding, remarkable, brilliant, beautiful, stunning,
impressive, positive, beneficial, successful, effective, efficient, valuable, important, significant, notable, noteworthy,
commendable, exceptional, favorable, promising, optimistic, encouraging, rewarding""")
NEGATIVES = _words("""bad, terrible, awful, horrible, worst, worse, hate, hated, disappointing, disappointed, disappointment, poor,
poorly, fail, failed, failure, wrong, incorrect, error, flaw, flawed, defective, negative, harmful, damaging, concerning,
troubling, problematic, inadequate, insufficient, ineffective, inefficient, useless, pointless, boring, dull, uninteresting,
confusing, confused, unclear, vague, ambiguous, questionable, dubious, weak""")
PREPOSITIONS = _words("""about, above, across, after, against, along, among, around, at, before, behind, below, beneath, beside,
between, beyond, by, down, during, except, for, from, in, inside, into, near, of, off, on, onto, out, outside, over, through,
throughout, to, toward, under, until, up, upon, with, within, without""")
ADJECTIVE_SUFFIXES = _words("ful, less, ous, ive, able, ible, al, ant, ent, ic, ish, like")
NOMINALIZATION_SUFFIXES = _words("tion, sion, ment, ness, ity, ance, ence, ship, hood, dom")
SUBORDINATORS = _words("""because, although, though, while, whereas, since, unless, until, before, after, as, if, whether, provided,
supposing, assuming, given, even, once, whenever, wherever, whoever, whichever, so, that""")
PASSIVE_AUXILIARIES = _words("is, are, was, were, be, been, being, has, have, had")
PASSIVE_PARTICIPLES = _words("""made, done, seen, given, taken, known, shown, found, held, kept, left, put, set, sent, brought,
bought, caught, taught, sold, told, paid, laid, said, read, written, driven, chosen, fallen, eaten, hidden, ridden, risen, woven,
stolen, forgotten""")
PUNCTUATION = ".,;:!?()[]{}\"'-"

# Lists of the training profile that differ from those above.
TRAIN_HEDGES = _words("""may, might, could, possibly, perhaps, probably, likely, appears, seems, suggests, indicates,
tentatively, presumably, arguably, approximately, generally, often, sometimes, tend, tends, tended, appear, suggest, indicate,
assume, assumes, assumed, possible, potential, potentially, conceivably, loosely, roughly, around, about, somewhat, relatively,
seemingly""")
TRAIN_CONNECTORS = _words("""however, therefore, thus, hence, consequently, nevertheless, furthermore, moreover, additionally,
also, besides, likewise, similarly, conversely, alternatively, subsequently, finally, firstly, secondly, thirdly, lastly,
meanwhile, nonetheless, instead, otherwise, accordingly, specifically, notably, importantly, significantly, overall, ultimately,
essentially, previously, initially""")
TRAIN_STOPWORDS = _words("""the, a, an, is, are, was, were, be, been, being, have, has, had, do, does, did, will, would, could,
should, may, might, shall, can, of, in, to, for, with, on, at, by, from, and, or, but, not, it, its, this, that, these, those,
as, if, so, than, then, when, where, which, who, what, how, all, more, most, any, each, no, into, up, out, about, through, over,
after, before, between, under, above, just, also, both, very, too, only, even, back, there, here, well, still, such, other, same,
them, their, they, he, she, him, his, her, our""")

# Lists of the adversarial profile.
ADVERSARIAL_HEDGES = _words("""may, might, maybe, perhaps, possibly, probably, likely, appears, seems, suggests, could, would,
should, about, approximate, approximately, virtually, generally, relatively, somewhat, rather, quite, nearly, almost, apparently,
presumably, supposedly, allegedly, reportedly""")
ADVERSARIAL_BOOSTERS = _words("""clearly, obviously, definitely, certainly, evidently, indeed, truly, always, never, absolutely,
completely, totally, entirely, unquestionably, undeniably, undoubtedly, proves, demonstrates, establishes, confirms, shows,
reveals""")
ADVERSARIAL_CONNECTORS = _words("""however, therefore, moreover, furthermore, nevertheless, nonetheless, thus, hence,
consequently, accordingly, additionally, also, besides, indeed, instead, meanwhile, otherwise, rather, alternatively,
subsequently, finally, first, second, third, next, then""")
ADVERSARIAL_SELVES = _words("i, me, my, mine, we, us, our, ours, myself, ourselves")
ADVERSARIAL_STOPWORDS = _words("""the, a, an, and, or, but, in, on, at, to, for, of, with, by, from, as, is, are, was, were, be,
been, being, have, has, had, do, does, did, will, would, could, should, may, might, must, can, this, that, these, those, it, its,
they, them, their, there, here, where, when, why, how, what, which, who, whom, whose""")

# Words by language.
LANGUAGES = {
    "es": {
        "hedge": _words("puede, podria, posiblemente, quizas, tal, vez, probablemente, parece, sugiere, indica, aproximadamente, generalmente, a menudo, a veces, tiende, posible, potencial, presumiblemente, arguablemente, concebiblemente"),
        "booster": _words("claramente, obviamente, indudablemente, ciertamente, definitivamente, demuestra, demuestran, prueba, prueban, confirma, confirman, muestra, muestran, siempre, nunca, absolutamente, evidentemente, efectivamente, fuertemente"),
        "connector": _words("sin, embargo, por, lo, tanto, asi, consiguiente, ademas, tambien, igualmente, de, manera, similar, el, contrario, finalmente, mientras, no, obstante, en, cambio, otra"),
        "self_mention": _words("nosotros, nuestro, nos, yo, mi, me, me mismo"),
    },
    "fr": {
        "hedge": _words("peut, pourrait, possiblement, peut-etre, probablement, semble, suggere, indique, approximativement, generalement, souvent, parfois, tend, possible, potentiel, potentiellement, presumablement, arguablement"),
        "booster": _words("clairement, evidemment, indeniablement, certainement, definitivement, demontre, demontrent, prouve, prouvent, confirme, confirment, montre, montrent, toujours, jamais, absolument, effectivement, fortement"),
        "connector": _words("cependant, toutefois, donc, par, consequent, ainsi, de, plus, en, outre, egalement, maniere, similaire, revanche, finalement, pendant, ce, temps, neanmoins, autrement"),
        "self_mention": _words("nous, notre, je, mon, ma, me, moi, moi-meme"),
    },
    "de": {
        "hedge": _words("kann, koennte, moeglicherweise, vielleicht, wahrscheinlich, scheint, deutet, hin, weist, etwa, im, allgemeinen, oft, manchmal, tendiert, moeglich, potenziell, vermutlich, argumentierbar"),
        "booster": _words("klar, offensichtlich, zweifellos, gewiss, definitiv, demonstriert, beweist, bestaetigt, zeigt, immer, nie, absolut, eindeutig, tatsaechlich, stark, notwendigerweise"),
        "connector": _words("jedoch, daher, folglich, somit, ausserdem, zudem, ebenfalls, aehnlich, umgekehrt, schliesslich, waehrend, nichtsdestotrotz, stattdessen, andernfalls, entsprechend"),
        "self_mention": _words("wir, unser, uns, ich, mein, mich, mir, mich selbst"),
    },
    "zh": {
        "hedge": _words("可能, 也许, 或许, 大概, 似乎, 表明, 指出, 大约, 一般, 通常, 往往, 有时, 倾向于, 可能的, 潜在的"),
        "booster": _words("显然, 明显地, 无疑, 当然, 确实, 证明, 证实, 显示, 总是, 从不, 绝对, 明确地, 事实上, 强烈"),
        "connector": _words("然而, 因此, 从而, 此外, 而且, 同样, 类似地, 相反, 最后, 同时, 尽管如此, 反而, 否则, 相应地"),
        "self_mention": _words("我们, 我们的, 我, 我的, 自己"),
    },
}
LANGUAGE_MARKERS = {
    "en": [" the ", " is ", " are ", " and ", " of ", " to ", " in "],
    "es": [" el ", " la ", " es ", " y ", " de ", " en ", " que "],
    "fr": [" le ", " la ", " est ", " et ", " de ", " en ", " que "],
    "de": [" der ", " die ", " das ", " und ", " von ", " in ", " ist "],
}

# Maps of the corpus operators.
SOURCE_REGISTERS = [("reddit", "social"), ("peerread", "academic"), ("arxiv", "academic"), ("wikihow", "encyclopedic"), ("wikipedia", "encyclopedic"), ("news", "news"), ("book", "creative"), ("essay", "creative"), ("reuter", "news"), ("yelp", "social")]
DOMAIN_REGISTERS = {"news": "news", "reddit": "social", "reviews": "social", "abstracts": "academic", "wiki": "encyclopedic", "books": "creative", "poetry": "creative"}
LEAST_WORDS = {"academic": 100, "news": 150, "social": 30, "encyclopedic": 100, "creative": 100}
MODEL_GROUPS = [("human", ["human"]), ("openai", ["gpt4", "chatgpt", "gpt-3", "gpt3", "gpt2"]), ("llama", ["llama"]), ("mistral", ["mistral"]), ("cohere", ["cohere"]), ("mpt", ["mpt"])]

# Characters of the defensive normaliser.
HOMOGLYPHS_FROM = "асеорхуіѕјԁһԝАВСЕНІЈКМОРЅТХҮ"
HOMOGLYPHS_TO = "aceopxyisjdhwABCEHIJKMOPSTXY"
HIDDEN_CHARACTERS = r"[\x{200b}-\x{200d}\x{feff}\x{200e}\x{200f}\x{202a}-\x{202e}\x{ad}\x{2060}-\x{206f}\x{0e00}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}]"

# Replacements of the perturbation operators.
SYNONYMS = {
    "important": "key", "significant": "notable", "demonstrates": "shows", "however": "but", "therefore": "so", "furthermore": "also",
    "additionally": "also", "consequently": "as a result", "nevertheless": "still", "moreover": "besides", "subsequently": "then",
    "alternatively": "or", "utilize": "use", "commence": "start", "terminate": "end", "facilitate": "help", "endeavor": "try",
    "ascertain": "find out", "fundamental": "basic", "substantial": "large", "approximately": "about", "sufficient": "enough", "numerous": "many",
}


def lists_of(lang: str) -> dict[str, list[str]]:
    """Hedges, boosters, connectors and self-mentions of a language; English ones for any other."""
    return LANGUAGES.get(lang, {"hedge": HEDGES, "booster": BOOSTERS, "connector": CONNECTORS, "self_mention": SELF_MENTIONS})

# Characters of the plain look-alike replacement.
PLAIN_FROM = "аеорсухАВЕКМНОРСТХ–—‘’“”"
PLAIN_TO = "aeopcyxABEKMHOPCTX--''\"\""
