"""Problem 6: error pages, script notices, filler and unfilled templates.

Method: labelled exemplars of residue stand in an inverted index (token ->
exemplars); passage windows (sentences) are looked up in it and scored by
TF-IDF containment: the weight of an exemplar's tokens that the window holds,
over all of its weight, and the window's own weight covered the same way.
Weights come from document counts over the whole corpus.  Unfilled slots are
one token whatever they are called; filler is matched on word beginnings.

A record is excluded if a window holds an unfilled slot, a template phrase or
filler of the record's own, or if notices cover it: beyond them, the lines the
site puts into many records (problem 1) and headlines, fewer than
``CONTENT_WORDS`` words are left.  Slots, filler and notices in the site's own
lines are looked for as well, since an error page may be the answer to many
addresses; they count like notices, so an article beside them stays.  Windows nearer to an exemplar labelled as a
mention, and slots in quotation marks, only speak of such things.

Scale.  Document counts are taken of the exemplars' tokens only, one row per
token and map task.  A window can reach the threshold only with one of the
tokens that hold most of an exemplar's weight; the JVM drops the documents
without any of those and without a slot or filler before Python sees them.
Nothing else is shuffled; texts stay where they are.

Defined cases.  Null, empty and blank texts are never excluded.  Repeated rows
come out repeatedly.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.site_lines import clean
from tidewatch.session import materialize

CONTAINED = 0.7
COVERED = 0.5
MENTIONED = 0.5
#: A passage is a notice too if the words of all notices together hold this share of its weight, and are so many.
COVERED_TOGETHER = 0.7
TOGETHER = 3
CONTENT_WORDS = 30
FILLER_SHARE = 0.8
FILLER_WORDS = 8

# Labelled exemplars, fixed values: phrases of web servers, proxies, runtimes,
# browsers and content systems as they are commonly met, none taken from the
# project's tables.  ``notice`` counts where it stands for the content,
# ``template`` wherever it stands, ``mention`` speaks of either.
NOTICES = """
error 404
error 404 not found
404 page not found
page not found
file or directory not found
oops that page can not be found
sorry we can not find the page you requested
the page you requested could not be found
the page you were looking for does not exist
this page does not exist or is no longer available
we could not find that page
it may have been moved or deleted
this page could not be found try searching or return home
the link may be broken or the page may have been moved removed deleted or renamed
it looks like nothing was found at this location maybe try a search
use the search box or go back to the home page
return to the homepage
410 gone
the requested resource is no longer available and has been removed
400 bad request
your browser sent a request that this server could not understand
401 unauthorized
403 forbidden
access denied
you are not authorized to view this page
you do not have permission to access this resource on this server
429 too many requests
500 internal server error
the server encountered an internal error and was unable to complete your request
an unexpected error occurred
something went wrong
please try again later
an application error has occurred error code
our team has been notified of this incident
we have been told about the problem
your request could not be completed
the request was not processed
502 bad gateway
the proxy server received an invalid response from an upstream server
503 service unavailable
service temporarily unavailable
the server is temporarily unable to service your request due to maintenance downtime or capacity problems
the site is down for scheduled maintenance
504 gateway timeout
gateway time out
gateway timed out
the upstream server did not respond in time
the host did not answer within the time allowed
no answer from host after seconds
connection timed out after seconds
this site can not be reached
error establishing a database connection
fatal error uncaught exception thrown in on line
warning undefined variable on line
stack trace main thrown
main thrown
unhandled exception
undefined
object object
nan
null
nan null
you need to enable javascript to run this app
please enable javascript to view this page
please enable javascript and cookies to continue
please turn on javascript in your browser and reload the page
javascript is required
javascript is disabled in your browser
this site requires scripts to be enabled
this content can not be shown without scripts
enable scripts
enable scripting in your browser
scripts must be allowed to run
please switch on javascript to continue reading
cookies and javascript must be turned on to read this page
wait while we check your connection
just a moment
checking your browser before accessing
checking if the site connection is secure
needs to review the security of your connection before you continue
verify you are human
ray id
fehler 404
seite nicht gefunden
die angeforderte seite wurde nicht gefunden
die seite existiert nicht mehr oder wurde verschoben
zugriff verweigert
interner serverfehler
dienst nicht verfügbar
es ist ein fehler aufgetreten bitte versuchen sie es später erneut
bitte aktivieren sie javascript in ihrem browser
javascript ist deaktiviert
um die inhalte anzuzeigen muss javascript aktiviert sein
zum anzeigen dieser seite wird javascript benötigt
ein unerwarteter fehler ist aufgetreten
erreur 404
page introuvable
page non trouvée
la page que vous recherchez est introuvable ou a été déplacée
retour à la page d accueil
accès refusé
erreur interne du serveur
service indisponible
une erreur est survenue veuillez réessayer plus tard
veuillez activer javascript dans votre navigateur
ce site nécessite javascript
javascript doit être activé pour afficher cette page
revenir à l accueil
error 404
página no encontrada
la página que busca no existe o ya no está disponible
el enlace no está disponible
acceso denegado
error interno del servidor
servicio no disponible
se ha producido un error inténtelo de nuevo más tarde
debe activar javascript en su navegador
este sitio requiere javascript
vuelva a intentarlo más tarde
active javascript para ver esta página
"""
TEMPLATES = """
goes here
your text goes here
insert text here
insert title here
insert max words
insert headline here
insert heading here
insert summary here
insert image here
insert quote here
insert caption here
insert name here
add headline
add summary
add image
add caption
add quote
replace this text with your own
replace this placeholder text before publishing
add your text here
enter your text here
type your text here
click here to edit this text
placeholder text
sample text
this is a sample page
author name title
platzhaltertext
hier einfügen
hier eingeben
insérer ici
inserte aquí
text hier einfügen
titel hier einfügen
insérer le texte ici
insérer le titre ici
texte à remplacer
inserte aquí el texto
inserte aquí el título
texto de ejemplo
"""
MENTIONS = """
the report said users saw the message error 404
a study of page not found messages
sites that fail when javascript is switched off
the placeholder was printed in the letter
the template variable is filled in later
the word stands for text that nobody has written
"""
# Words by which a sentence speaks of slots.
SLOT_WORDS = frozenset(
    "placeholder placeholders template templates variable variables schema syntax manual boilerplate merge markup letter letters slip misprint typo "
    "platzhalter vorlage formbrief musterbrief variablen versehen modèle gabarit lettre courrier formulaire coquille plantilla marcador marcadores carta formulario descuido errata".split()
)
# Beginnings of the words of the usual filler text.
FILLER = frozenset(
    "lor ips dol sit ame con ect adi pis eli sed eiu tem inc lab mag ali eni min ven qui nos exe ull nis com dui aut iru rep vol "
    "vel ess cil fug nul par exc occ cup non pro sun cul off des mol est orn leo qua por tur pus pur are arc lec"
    " met vit jus ris sag ull ult var viv vul".split()
)

_SLOT = (
    r"\{(?:\d{1,2}|[A-Za-z]+_\w{1,40}|[A-Z]{3,40})\}|(?:<|&lt;)[?][=a-z][^\n?]{0,80}[?](?:>|&gt;)|&lt;%[=-]?[^%\n]{0,80}%&gt;"
    r"|\{\{\{?[^{}\n]{0,60}\}?\}\}|\$\{[^{}\n]{1,60}\}|\{%[^%\n]{0,160}%\}|<%[=-]?[^%\n]{0,80}%>|%%[^\W\d][\w -]{1,40}%%"
    r"|%[A-ZÀ-Þ_]{3,40}%|\[\[[^\[\]\n]{1,60}\]\]|<<[A-Za-z][\w -]{1,40}>>|__[A-Z][A-Z_ ]{2,40}?__|@@[A-Za-z][\w -]{1,40}@@"
    r"|#[A-Z][A-Z_]{2,30}#|\[[A-ZÀ-Þ][A-ZÀ-Þ_ -]{2,40}\]|\bXX+(?=\s*(?:%|percent|per cent|Prozent|pour cent|por ciento|million|PERCENT))|\bXX+[.,]X+\b"
)
SLOT = re.compile(_SLOT)
#: The same for the JVM's filter, coarser: it may let too much pass, never too little.
SLOT_MARKS = ("{{", "${", "{%", "<%", "%%", "[[", "<<", "__", "@@", "XX", "<?", "&lt;?", "&lt;%")
SLOT_PATTERNS = (("{", r"\{[\p{L}\d_]+\}"), ("%", r"%[\p{Lu}_]{3,}%"), ("#", r"#[A-Z_]{3,}#"), ("[", r"\[\p{Lu}[\p{Lu}_ -]+\]"))
#: Eight words of which four fifths are filler have three such words in a row.
_BY_LETTER = {f[0]: sorted(g[1:] for g in FILLER if g[0] == f[0]) for f in sorted(FILLER)}
FILLER_JVM = r"(?:\b(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in _BY_LETTER.items()) + r")\p{L}*[^\p{L}\p{N}]+){3}"
OPEN_QUOTES, CLOSE_QUOTES = "“„«‘‹\"'", "”“»’›\"'"
#: Windows end with sentences; what stands in brackets is a window of its own.
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+|(?<=[。！？])|(?=(?<!\[)\[(?!\[)[^\[\]\n]*[a-zà-þ][^\[\]\n]*\])|(?<=[a-zà-þ]\])\s")
TOKEN = re.compile(r"[^\W\d_]+|\d+")
CODE = re.compile(r"\b(?=\w*\d)(?=\w*[a-z])[0-9a-z]{5,}(?:\.[0-9a-z]+)*\b", re.IGNORECASE)
SLOT_TOKEN = "\x00slot"


#: Words are compared by so many letters, so that their endings don't count.
STEM = 5


def words_of(text: str) -> list[str]:
    """Lower-case words; numbers as they are up to three digits, else '0'; codes of letters and digits as '0'."""
    return [t if not t[0].isdigit() or len(t) == 3 else "0" for t in TOKEN.findall(CODE.sub("0", text.lower()))]


def tokens(text: str) -> list[str]:
    """The beginnings of the words."""
    return [t[:STEM] for t in words_of(text)]


def _exemplars() -> list[tuple[str, frozenset[str]]]:
    found = []
    for label, block in (("notice", NOTICES), ("template", TEMPLATES), ("mention", MENTIONS)):
        found += [(label, frozenset(tokens(line))) for line in block.strip().splitlines()]
    return found


class Index:
    """Inverted index over the exemplars, weighted by the corpus's document counts."""

    def __init__(self, counts: dict[str, int], documents: int):
        self.exemplars = _exemplars()
        self.most = math.log(1 + max(documents, 1))
        vocabulary = {t for _, ts in self.exemplars for t in ts}
        self.weight = {t: math.log(1 + max(documents, 1) / (1 + counts.get(t, 0))) + 0.05 for t in vocabulary}
        self.total = [sum(self.weight[t] for t in ts) for _, ts in self.exemplars]
        self.postings: dict[str, list[int]] = {}
        for i, (_, ts) in enumerate(self.exemplars):
            for t in ts:
                self.postings.setdefault(t, []).append(i)

        self.noticed = {t for label, ts in self.exemplars if label == "notice" for t in ts}
        self.telling, self.template_keys = set(self.keys("notice")), set(self.keys("template"))

    def keys(self, wanted: str) -> list[str]:
        """Tokens without any of which no exemplar of a label can be contained."""
        found = set()
        for (label, ts), total in zip(self.exemplars, self.total):
            if label == wanted:
                held = 0.0
                for t in sorted(ts, key=lambda t: (-self.weight[t], t)):
                    found.add(t)
                    held += self.weight[t]
                    if held > (1 - CONTAINED) * total:
                        break
        return sorted(found)

    def scores(self, window: set[str]) -> dict[str, tuple[float, float]]:
        """Best (containment, coverage of the window) by label."""
        held: dict[int, float] = {}
        for t in window:
            for i in self.postings.get(t, ()):
                held[i] = held.get(i, 0.0) + self.weight[t]
        whole = sum(self.weight.get(t, self.most) for t in window) or 1.0
        best: dict[str, tuple[float, float]] = {}
        for i, w in held.items():
            label = self.exemplars[i][0]
            score = (w / self.total[i], w / whole)
            if score > best.get(label, (0.0, 0.0)):
                best[label] = score
        return best

    def is_notice(self, window: set[str]) -> bool:
        """Whether notices cover a passage: one exemplar contained in it and covering half of it, or all of them together most of it."""
        best = self.scores(window)
        held, covered = best.get("notice", (0.0, 0.0))
        if best.get("mention", (0.0, 0.0))[0] >= max(held, MENTIONED):
            return False
        if held >= CONTAINED and covered >= COVERED:
            return True
        known = window & self.noticed
        whole = sum(self.weight.get(t, self.most) for t in window) or 1.0
        return len(known) >= TOGETHER and bool(known & self.telling) and sum(self.weight[t] for t in known) >= COVERED_TOGETHER * whole


def _own_slot(window: str, line: str, index: Index) -> bool:
    """Whether a window holds an unfilled slot that it doesn't merely speak of."""
    found = [m for m in SLOT.finditer(window) if not (m.group()[0] == "[" and m.group()[1] != "[" and m.group() == line.strip(" *•»|›…\t\r"))]
    if not found:
        return False
    words = set(words_of(SLOT.sub(" ", window)))
    if words & SLOT_WORDS or index.scores({w[:STEM] for w in words}).get("mention", (0, 0))[0] >= MENTIONED:
        return False
    return any(not (window[m.start() - 1 : m.start()] in OPEN_QUOTES and m.start() and window[m.end() : m.end() + 1] and window[m.end()] in CLOSE_QUOTES) for m in found)


def _is_filler(words: list[str]) -> bool:
    letters = [w for w in words if not w[0].isdigit()]
    return len(letters) >= FILLER_WORDS and sum(w[:3] in FILLER for w in letters) >= FILLER_SHARE * len(letters)


def is_residue(text: str | None, index: Index, own: frozenset[str] | None = None, special: bool = True) -> bool:
    """Whether a text holds residue where real content belongs; with ``own``, all other lines are the site's.

    Without ``special`` it is known to hold no slot, filler or template, so
    reading ends where enough content has been met.
    """
    if not text or text.isspace():
        return False
    notices, left = 0, 0
    before: set[str] = set()
    told = False
    for line in text.split("\n"):
        mine = own is None or line in own
        for window in SENTENCE.split(line):
            if not window or window.isspace():
                continue
            if special:
                words = words_of(SLOT.sub(" ", window))
                if _own_slot(window, line, index) or _is_filler(words):
                    if mine:
                        return True
                    notices += 1
                    continue
            else:
                words = words_of(window)
            here = {w[:STEM] for w in words}
            if special and here & index.template_keys:
                best = index.scores(here)
                held, covered = best.get("template", (0.0, 0.0))
                if held >= 0.85 and covered >= COVERED and best.get("mention", (0.0, 0.0))[0] < held:
                    if mine:
                        return True
                    notices += 1
                    continue
            # a passage is a sentence, or two of them; without a telling word neither is a notice
            told, before_told = bool(here & index.telling), told
            if left < CONTENT_WORDS and ((told and index.is_notice(here)) or ((told or before_told) and before and here and index.is_notice(before | here))):
                notices += 1
            elif mine and len(words) > 6 and window.rstrip()[-1:] in ".!?。！？…”’»\"')":
                left += max(len(words), len(window) // 6)
                if left >= CONTENT_WORDS and not special:
                    return False
            before = here
    return notices > 0 and left < CONTENT_WORDS


def found(items: DataFrame, key: str = "item_id", source: str = "institution", text: str = "extracted_text") -> DataFrame:
    """(key) of each record to be excluded."""
    rows = items.select(F.col(key).alias("tw_key"), F.col(source).alias("tw_src"), F.col(text).alias("tw_body"), F.col(text).alias("tw_whole"))
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, ts in _exemplars() for t in ts})])
    words = F.transform(F.split(F.lower("tw_body"), r"[^\p{L}\p{N}]+"), lambda w: F.left(w, F.lit(STEM)))
    counted = rows.select(F.explode(F.array_intersect(words, vocabulary)).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}  # at most one row per exemplar token
    documents = rows.where("tw_body IS NOT NULL").count()
    index = Index(counts, documents)
    telling, templates = (F.array(*[F.lit(k) for k in index.keys(label) if k != "0"]) for label in ("notice", "template"))
    body = F.col("tw_body")
    slot = reduce(or_, [body.contains(m) for m in SLOT_MARKS] + [body.contains(m) & body.rlike(p) for m, p in SLOT_PATTERNS])
    met = rows.withColumn("tw_words", words)
    special = slot | F.arrays_overlap("tw_words", templates) | F.lower("tw_body").rlike(FILLER_JVM)
    marked = met.select("tw_key", "tw_src", "tw_body", "tw_whole", special.alias("tw_special"), F.arrays_overlap("tw_words", telling).alias("tw_told"))
    suspects = clean(marked, "tw_src", "tw_body", keep=F.col("tw_special") | F.col("tw_told"))
    kind = suspects.schema["tw_key"].dataType.simpleString()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(counts, documents)
        for batch in batches:
            # equal lines are taken out together, so what is left tells which lines are the record's own
            rows = zip(batch["tw_whole"], batch["tw_body"], batch["tw_special"])
            hit = [is_residue(t, own, None if t is None or t == rest else frozenset(rest.split("\n")), s) for t, rest, s in rows]
            yield pd.DataFrame({key: batch.loc[hit, "tw_key"]})

    return suspects.select("tw_key", "tw_body", "tw_whole", "tw_special").mapInPandas(check, f"`{key}` {kind}")
