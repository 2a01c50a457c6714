"""Fixed word lists and small text tests shared by the answer operators."""

from __future__ import annotations

import re
from collections import Counter

# Frequent function words by language; a word in several languages counts for each.
STOPWORDS = {
    "en": "the and to of a i is my in it for on with that you this be was are have from not or as at your can what if will an by me which when there how would should may they has no we so but do any its only about them their",
    "de": "der die das und ist ich nicht mit ein eine zu den von auf für im dem sie es wird bei noch auch sich des als wie wenn zur aus nach hat oder aber bitte ihre einen einer vor gar nichts wer sollten schon",
    "fr": "le la les et de des du un une est je ne pas que qui pour dans sur avec il à au en ce vous votre mon ma plus par chez n l d qu aux a été puis donc encore avant peut être",
    "es": "el la los las y de que en un una es no por con para se mi su lo al del le ya me qué si cómo más hay o pero así todavía también puede según antes está",
    "pt": "o a os as e de que em um uma é não por com para se meu minha seu sua do da no na ao já me mais há ou mas ainda também pode antes está foi você nem pelo dos das",
    "ru": "и в не на что с по как это я для мы вы от к но из за у до же или если уже так его ещё бы при без мне мой моя где когда чтобы нет да",
    "it": "il lo la gli le e di che in un una è non per con si mio mia suo sua del della al già mi più o ma ancora anche può prima sono nel dei",
    "nl": "de het een en van ik is niet met op voor in te dat die zijn aan er naar bij ook als maar of om mijn uw nog wel kan wordt heeft",
}
LANGS_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        LANGS_OF[_w] = (*LANGS_OF.get(_w, ()), _lang)
ANY_STOP = frozenset(LANGS_OF)
_LANGS = tuple(STOPWORDS)
_WIDE = 40
#: A number for each function word with a field of _WIDE bits a language, and one for the word itself: a sum of such numbers
#: counts the words of all languages at once, up to 2^40 words.
_ONE_OF = {w: sum(1 << _WIDE * _LANGS.index(x) for x in langs) + (1 << _WIDE * len(_LANGS)) for w, langs in LANGS_OF.items()}

#: Letters that point to one language or script.
MARKS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "çàâêèîôûœ", "pt": "ãõçêá", "ru": "ыэъщжшцюя"}
_MARKED = re.compile("[" + "".join(MARKS.values()) + "]")

# Whole answers that stand for nothing, and bare labels, in lower case without marks.
STAND_INS = frozenset(
    "na|n a|none|null|nil|nan|undefined|empty|blank|nothing|no answer|no response|no reply|no content|no output|no text|"
    "not available|not applicable|not provided|unavailable|missing|unknown|answer missing|answer unavailable|void|"
    "keine antwort|sin respuesta|aucune réponse|sem resposta|нет ответа|none given|no data|tbd|pending|eos|bos|pad|"
    "end|stop|eot|unk|endoftext|im end|im start".split("|")
)
LABELS = frozenset("assistant|answer|response|reply|bot|ai|output|agent|system|user|a|model|final answer|completion|support|antwort|respuesta|réponse|resposta|ответ|result|text|message".split("|"))
_CONTROL = re.compile(r"<\|[^|<>]{0,40}\|>|</?s>|\[/?(?:INST|EOS|PAD|BOS|END)\]|<(?:eos|bos|pad|unk|end|eot)>|<(?:start|end)_of_turn>", re.I)
_LABEL = re.compile(r"^\W*([^\W\d_]+(?: [^\W\d_]+)?)\s*[:：>]\s*$")
WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(_CONTROL.pattern + r"|([^\W_]+)", re.I)
_MOST = max(len(x.split()) for x in STAND_INS | LABELS)


#: So many plain words at the start that no stand-in, label or control token can hold them.
_PLAIN = re.compile(rf"(?:[^\W_]+ ){{{_MOST + 1}}}")


def is_empty_answer(text: str | None) -> bool:
    """No words of its own: missing, blank, marks only, a stand-in for nothing, a bare label or a control token."""
    if text is None:
        return True
    if _PLAIN.match(text):
        return False
    w = []
    for m in _PIECE.finditer(text):
        if m[1]:
            if len(w) == _MOST:
                return False  # more words than any stand-in or label has
            w.append(m[1].lower())
    if not w:
        return True
    return " ".join(w) in STAND_INS or bool((m := _LABEL.match(_CONTROL.sub(" ", text))) and m[1].lower() in LABELS)


def language(tokens: list[str]) -> tuple[str | None, float]:
    """(language, share of its function words among all words that are function words of any), None if unsure."""
    total = sum(filter(None, map(_ONE_OF.get, tokens)))
    n = total >> _WIDE * len(_LANGS)
    if n < 2:
        return None, 0.0
    counts = [total >> _WIDE * i & (1 << _WIDE) - 1 for i in range(len(_LANGS))]
    best = max(counts)
    if counts.count(best) > 1:
        return None, 0.0
    return _LANGS[counts.index(best)], best / n


def script_language(text: str) -> str | None:
    """Language that the special letters point to, None without any."""
    if text.isascii():
        return None
    found = Counter(_MARKED.findall(text.lower()))
    if not found:
        return None
    best = {k: sum(found[x] for x in v) for k, v in MARKS.items()}
    top = max(best, key=best.get)
    return top if best[top] >= 2 else None


# Refusals: cheap cues first, then sentence classes. Each alternative of REFUSE holds a cue.
CUES = ("declin", "unable", "not able", "cannot", "can't", "can’t", "can not", "won't", "won’t", "not permitted", "not allowed", "rather not", "prefer not", "something else", "pass on", "outside ", "beyond ", "not something", "no answer", "guidelines", "my abilities", "refus", "not comfortable", "not in a position", "not going to", "not wish to", "n't wish to", "n’t wish to", "could not", "will not", "cant ", "against my ", "no reply", "no comment", "another topic", "allowed to answer", "ne peux pas", "ne puis pas", "no puedo", "nicht helfen", "nicht beantworten", "não posso", "не могу")
_VERB = r"(?:assist|help|answer|respond|reply|comment|discuss|talk|speak|engage|provide|process|fulfil|comply|do (?:that|this|so)|address|support|get into|share|continue|advise)"
REFUSE = re.compile(
    rf"(?:(?:unable|not able|not permitted|not allowed|not comfortable|won['’]t be able|not in a position)(?: to)? ?{_VERB}|(?:\bcant|can['’]t|can not|cannot|won['’]t|will not|could not|do not wish to|don['’]t wish to|not going to) (?:\w+ )?{_VERB}|(?:must|have to|need to|would|i|will|shall) (?:\w+ )?(?:declin|refus|pass on)|(?:['’]d|would|i) (?:rather|prefer) not (?:to )?(?:{_VERB}|say|go into|get)|can(?:not|['’]t| not) be (?:processed|answered|handled|completed|fulfilled)|not something (?:i|we) (?:can|may)|(?:outside|beyond) (?:of )?(?:what (?:i|we)|my (?:scope|remit))|no (?:answer|reply|comment) can be given|(?:talk|speak) about something else|against my (?:guidelines|rules|policy)|ne (?:peux|puis) pas (?:vous )?(?:aider|répondre)|no puedo (?:ayudar|responder)|kann (?:ich )?.{{0,40}}nicht (?:helfen|beantworten)|não posso (?:ajudar|responder)|не могу (?:помочь|ответить))",
)
#: Cues that ordinary answers hold as well; with no other cue, a decline needs one of them before a verb of help.
CAN = frozenset(("cannot", "can't", "can’t", "can not", "won't", "won’t", "cant ", "could not", "will not"))
CANNOT = re.compile(rf"(?:\bcant|cannot|can['’]t|can not|won['’]t|could not|will not) (?:\w+ )?(?:{_VERB}|be (?:processed|answered|handled|completed|fulfilled|able))")
#: A search that every text which may decline passes, as one automaton over a column: a cue that is no CAN, or a CANNOT.
MAY_DECLINE = "(?i)" + "|".join([re.escape(c) for c in CUES if c not in CAN] + [rf"(?:cant|cannot|can['’]t|can not|won['’]t|could not|will not) (?:[\p{{L}}\p{{N}}_]+ )?(?:{_VERB}|be (?:processed|answered|handled|completed|fulfilled|able))"])
FILLER = re.compile(
    r"^(?:[\W_]*(?:i['’]?m (?:very |so |really )?(?:sorry|afraid)|sorry|my apologies|apologies|unfortunately|with regret|regrettably|thank(?:s| you)[^.!?]{0,24}|hello[^.!?]{0,12}|hi[^.!?]{0,12}|as an? (?:automated|ai|virtual|language)[^.!?]*|please (?:ask|choose|pick|try|understand)[^.!?]*(?:topic|question|something else|understand)[^.!?]*|is there (?:something|anything) else[^.!?]*|(?:i )?(?:do not|don['’]t|have no) (?:have )?(?:any )?(?:personal )?opinions[^.!?]*|i hope you understand[^.!?]*|(?:it|this|that) (?:is|goes) (?:beyond|against|outside)[^.!?]*|let['’]?s talk about[^.!?]*)[\W_]*)$",
)
_TURN = re.compile(r"\b(?:but|though|however|yet|although)\b.{0,20}\b(?:steps|here is|here are|you (?:can|could|may)|below)\b")
_SENT = re.compile(r"(?<=[.!?])\s+|\n+")


def refusal_votes(low: str, cues=CUES) -> tuple[bool, bool]:
    """(a sentence declines, every sentence declines or fills) for a lower-cased text; cues: those that it holds."""
    parts = [s for s in _SENT.split(low) if s]
    decline = [any(c in s for c in cues) and bool(REFUSE.search(s)) for s in parts]
    if True not in decline:
        return False, False
    for s, d in zip(parts, decline):
        # a decline that turns to guidance inside one sentence is no pure refusal
        if (_TURN.search(s) if d else not FILLER.match(s) and len(WORD.findall(s)) >= 2):
            return True, False
    return True, True
