"""Template residue, filler, error pages and script notices in place of content.

Three kinds are told apart, each by grammars over the text itself:

* ``placeholder``: one grammar a delimiter. Delimiters that only templates use hold any field name; delimiters that prose
  uses too (square and angle brackets, single braces) hold only what has the form of a field;
* ``filler``: sentences of pseudo-Latin, of one word or phrase repeated, of x-words, or that announce text to come;
* ``notice``: sentences of an error page or of a request for scripts. Signs that need no language (status codes with their
  reason, stack traces, error constants, server names) count by themselves; else a sentence must join two notions (what is
  served and how it failed; scripts and switching them on; what was asked for and a denial) in the form notices have.

Speech about such things differs by context. Code blocks, code lines, quotations and bracketed remarks are left out; a
placeholder is let go where its own sentence explains templates or code, and where most lines of a text are code; a notice
is let go where someone in its sentence tells, asks or is told.

Every rule needs a sign, a repetition or one of the words in ``_triggers``, an automaton built from the rules' own
vocabularies. A text is read by it once and most texts end there; in the others only the sentences with a trigger meet the
rules. (A regular expression of the same words inside the JVM was measured and costs ten times as much.)
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _trie(phrases: Iterable[str]) -> str:
    """A pattern for any of the phrases, common beginnings tried once; a blank in a phrase is any white space."""
    root: dict = {}
    for p in phrases:
        at = root
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def show(node: dict) -> str:
        parts = [("\\s+" if c == " " else re.escape(c)) + show(node[c]) for c in sorted(k for k in node if k)]
        if not parts:
            return ""
        one = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return one if "" not in node else f"(?:{one})?"

    return show(root)


def _words(text: str) -> list[str]:
    """The phrases of a list separated by slashes or line ends."""
    return [w.strip() for w in re.split(r"[/\n]", text) if w.strip()]


# ---- vocabularies, all in lower case

# The words of the usual pseudo-Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# The element names of HTML.
_ELEMENTS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl doctype dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param pre progress q s samp script section select small span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr xml".split()
)
# The reason phrases of HTTP, as servers spell them.
_REASONS = _words(
    """bad request/unauthorized/unauthorised/payment required/forbidden/not found/page not found/file not found/method not allowed/not acceptable/proxy authentication required/request timeout/request time-out/request timed out
    gone/length required/precondition failed/payload too large/request entity too large/uri too long/request-uri too long/unsupported media type/too many requests/internal server error/internal error/server error
    not implemented/bad gateway/service unavailable/service temporarily unavailable/temporarily unavailable/gateway timeout/gateway time-out/gateway timed out"""
)
#: Whole sentences, or heads before a stop or colon, that are notices by themselves.
_OUTRIGHT = [
    x
    for x in _REASONS
    if x not in ("gone", "unauthorized", "unauthorised", "not acceptable", "not implemented", "temporarily unavailable", "length required", "not found")
] + _words(
    """access denied/permission denied/access forbidden/connection refused/connection reset/connection timed out/connection closed/connection lost/too many redirects/server busy/attention required/under construction
    zugriff verweigert/zugriff nicht erlaubt/serverfehler/interner serverfehler/erreur interne/erreur interne du serveur/accès refusé/accès interdit/acceso denegado/accesso negato/acesso negado/toegang geweigerd"""
)
_SERVERS = _words("nginx/apache/openresty/cloudflare/litespeed/lighttpd/varnish/tomcat/envoy/caddy/microsoft-iis/gunicorn/haproxy/squid/akamaighost")
#: What is served on the web and on little else; and what is, but on much else too.
_SERVED = _words("server/servers/web server/website/web site/webpage/web page/url/hyperlink/link you followed/gateway/hostname/browser/web address/webseite/internetseite/website/serveur/servidor/sito web/sitio web/dns")
_SERVED_TOO = _words(
    """page/site/file/directory/document/record/content/service/session/request/connection/address/resource/host/domain/account/network/application/app/link/image/video/database/proxy
    seite/datei/dokument/dienst/sitzung/anfrage/verbindung/adresse/inhalt/protokoll/page/fichier/document/ressource/connexion/contenu/requête/lien
    página/archivo/recurso/sesión/contenido/enlace/servicio/pagina/risorsa/sessione/contenuto/servizio/arquivo/sessão/conteúdo/serviço/bestand/sessie/verbinding/pagina"""
)
#: Failures told as notices tell them, and plain words that need a plain web subject beside them.
_FAILED = _words(
    """not found/not be found/can't be found/couldn't be found/cannot be found/unavailable/not available/not currently available/no longer available/no longer exists/does not exist/doesn't exist/no longer leads/not exist/timed out/time-out/timeout/has expired/is expired/expired/not be reached/can't be reached
    unreachable/not reachable/isn't working/not working/not responding/not be displayed/cannot be displayed/can't be displayed/not be shown/cannot be shown/not be loaded/could not be loaded/not accessible/has been suspended/is suspended/has been removed/has been moved/has moved/may be broken/was interrupted/access denied/permission denied
    invalid response/not supported/under construction
    nicht gefunden/nicht vorhanden/nicht verfügbar/nicht erreichbar/existiert nicht/nicht mehr/abgelaufen/verweigert/nicht erlaubt/nicht angezeigt/nicht geladen/gesperrt
    introuvable/n'existe pas/n'existe plus/non trouvé/non trouvée/indisponible/expiré/expirée/ne répond pas/inaccessible/pas disponible
    no encontrada/no encontrado/no existe/no disponible/no está disponible/caducada/caducado/expirada/expirado/non trovata/non trovato/non esiste/non disponibile/scaduta/scaduto
    não encontrada/não encontrado/não existe/indisponível/não está disponível/niet gevonden/bestaat niet/niet beschikbaar/verlopen/niet bereikbaar"""
)
_FAILED_TOO = _words("did not answer/didn't answer/did not respond/does not respond/didn't respond/is not answering/not answer/denied/refused/reset/closed/busy/overloaded/down/failed/broken/blocked/lost/moved/stopped/error/errors/fehler/erreur")
#: Denials that follow what was asked for.
_DENIED = [*_FAILED, *_words("not/cannot/can't/couldn't/wasn't/isn't/doesn't/removed/moved/broken/deleted/nicht/gelöscht/n'est/n'a/ne/pas/no/non/não/niet/verwijderd")]
_ASKED = _words(
    """requested/you asked for/you are looking for/you're looking for/you were looking for/you requested/you followed/you tried/you entered/you have requested/gewünschte/gewünschten/angeforderte/angeforderten/gesuchte/gesuchten
    demandé/demandée/recherché/recherchée/que vous recherchez/que vous cherchez/que vous avez demandé/que vous avez demandée/solicitada/solicitado/que buscas/que busca/está buscando/richiesta/richiesto/che stai cercando/che cerchi/opgevraagde/u zoekt/procurada/procura"""
)
_SCRIPTS = _words("javascript/java script/noscript/no-script/scripts/scripting/active content/cookies/cookie/browser/browsers/navigateur/navegador/aktive inhalte/contenu actif")
_SWITCHED = _words(
    """enable/enabled/enabling/disabled/activate/activated/allow/allowed/permit/permitted/turn on/turned on/turn it on/turn them on/switch on/switched on/switch it on/must be active/are active/required/requires/require/need/needs/needed/accept/accepted/supported/support/supports/unsupported/upgrade/update/outdated/out of date
    not run/blocks/blocked/blocking/without scripting/without javascript/without scripts/change this setting/your settings/uses javascript
    aktivieren/aktiviert/aktiv/einschalten/eingeschaltet/zulassen/benötigt/erfordert/erforderlich/deaktiviert/unterstützt/activer/activez/activé/activée/activés/autoriser/autorisez/nécessite/requis/désactivé/désactivée/prend pas en charge
    habilite/habilitar/habilitado/habilitados/active/activar/activa/activado/requiere/necesita/desactivado/deshabilitado/abilita/abilitare/abilitato/attiva/attivare/attivato/richiede/disabilitato/ative/ativar/ativado/requer/desativado/schakel/inschakelen/ingeschakeld/vereist/nodig"""
)
_ROBOTS = _words(
    """security check/not a robot/you are a robot/are you a robot/you are human/you are a human/you're human/being redirected/not redirected/not automatically redirected/you have been blocked/you've been blocked/your ip address/your ip/unusual traffic/automation tools/automated access/attention required
    your browser/site connection is secure/ray id/captcha/do not have permission/don't have permission/not have permission/not authorized to/not authorised to/not have access/log in again/sign in again/too many requests/from your network"""
)
_WRONG = _words(
    """something went wrong/looks like something/an error occurred/an error has occurred/an unexpected error/an unknown error/an internal error/an unexpected condition/error establishing/error loading/etwas ist schiefgelaufen/etwas ist schief/ein fehler ist aufgetreten/ein fehler aufgetreten/une erreur est survenue/une erreur s'est produite
    ha ocurrido un error/se ha producido un error/si è verificato un errore/ocorreu um erro/er is een fout opgetreden/oops/whoops/hoppla"""
)
_FAULT_NAMES = _words("error/fehler/fehlercode/erreur/errore/erro/fout/http/status/incident/reference/request id/error code/error id/ray id/proxy")
_MARKED = _words("sample/dummy/placeholder/filler/example/test/demo")
_STAND_INS = [
    *[f"{a} {b}" for a in _MARKED for b in ("text", "copy", "content", "paragraph", "sentence", "speech", "body", "article")],
    *_words(
        """blindtext/fülltext/platzhaltertext/mustertext/beispieltext/blindtexte/texte factice/texte fictif/texte d'exemple/texte de remplissage/faux texte/faux-texte/texto de ejemplo/texto de relleno/texto de prueba/texto simulado
        texto de exemplo/testo segnaposto/testo di esempio/testo fittizio/voorbeeldtekst/opvultekst/hier entsteht eine neue/lorem ipsum"""
    ),
]
_COMING = _words(
    """goes here/comes here/coming soon/to follow/to come/follows here/folgt/folgt in kürze/wird nachgereicht/à venir/próximamente/en construcción/in arrivo/em breve/volgt/volgt binnenkort/here"""
)
_PENDING_NOUNS = _words("text/content/copy/speech/transcript/page/site/website/details/information/photo/image/title/caption/paragraph/article/body/wortlaut/rede/inhalt/texte/contenu/contenido/contenuto/conteúdo/tekst")
_EMPTY = frozenset("undefined null nan none nil asdf qwerty foo test tbc tbd tba xyz".split())
#: Last words of the fields that forms and letters have.
_FIELD_NOUNS = frozenset(
    """name names firstname lastname surname fullname username nickname title salutation date day month year time deadline email mail phone telephone mobile fax number no id code ref reference address street city town state country zip postcode region company organisation organization
    employer institution party department position role amount total price sum fee count quantity result percentage subject topic item description text list link url website signature photo image picture logo product order invoice customer client recipient sender author speaker user member location venue place event
    vorname nachname anrede datum uhrzeit ort straße plz firma betrag name nummer telefon unterschrift titel prénom nom date adresse ville société montant numéro objet nombre apellido fecha empresa importe dirección ciudad nome cognome data azienda indirizzo cidade naam voornaam achternaam datum bedrijf""".split()
)
_FIELD_HEADS = frozenset("your my insert enter add first last full company customer client user recipient sender ihr ihre votre su il tuo uw placeholder".split())

# ---- placeholders

_ID = r"[^\W\d_]\w*(?:[.\-]\w+)*"
#: (sign, pattern with the field in a group). The fields of the first are fields whatever they are called.
_SURE = (
    r"\{\{[{&#/^>!]?\s*([^{}\n]+?)\s*\}\}",  # {{ name | filter }}
    r"\{%-?\s*([^{}%\n]+?)\s*-?%\}",  # {% name %}
    r"[$#]\{\s*([^{}\n]+?)\s*\}",  # ${name} #{name}
    r"\$\(\s*([\w.]+)\s*\)",  # $(name)
    r"<%[=-]?\s*([^<>%\n]+?)\s*-?%>",  # <%= name %>
    r"%%\s*([\w. ]+?)\s*%%",  # %%NAME%%
    r"@@\s*([\w. ]+?)\s*@@",  # @@name@@
    r"(?<![\w%])%\(([\w. ]+)\)[sdifr](?!\w)",  # %(name)s
    r"&lt;\s*([\w. ]+?)\s*&gt;",  # escaped <name>
)
_OPEN = (
    ("brace", r"(?<![\w{$#%\\])\{\s*([^\W\d][\w. |\-]*?)\s*\}(?!\})"),
    ("wiki", r"\[\[\s*([^\W\d][\w. ]*?)\s*\]\]"),
    ("square", r"(?<!\[)\[\s*([^\W\d][^\[\]\n]*?)\s*\](?![\](])"),
    ("angle", r"<([^\W\d][\w. ]*)>"),
    ("guillemet", r"«([^\W\d][\w.]*(?: [\w.]+)*)»"),
    ("under", r"(?<!\w)__([A-Z][A-Z0-9]*(?:[._][A-Z0-9]+)*)__"),
    ("percent", r"(?<![\w%])%([A-Z][A-Z0-9_]{2,})%(?![\w%])"),
    ("colon", r"(?<![\w:]):([a-z][a-z_]*):(?![\w:])"),
    ("blank", r"(?<!\w)[Xx]{3,}\s*\(([a-z]+(?:[ _.][a-z]+)*)\)"),
)
_FIELD = re.compile(r"(?=[{$#<%@&«_:\[Xx])(?:" + "|".join([f"(?P<sure{i}>{p})" for i, p in enumerate(_SURE)] + [f"(?P<{n}>{p})" for n, p in _OPEN]) + ")")
#: An open delimiter's form, tested before its name is; each needs one of these signs.
_FIELD_SIGN = re.compile(r"[{$#<%@&«_:\[Xx](?:(?<=\{)[\s%{\w]|(?<=[$#])[{(]|(?<=<)[%\w]|(?<=%)[%(A-Z]|(?<=@)@|(?<=&)lt;|(?<=«)\w|(?<=_)_[A-Z]|(?<=:)[a-z_]+:|(?<=\[)[\s\w\[]|(?<=[Xx])[Xx]{2,}\s*\()")
_PENDING_FIELD = re.compile(r"(?i)^(?:insert|enter|add|einfügen|insérer|insertar|inserire|todo|tbd|tbc|fixme|placeholder|your|ihr|ihre|votre)\b|\b(?:here|hier|ici|aquí|to be (?:supplied|added|inserted|confirmed|announced)|folgt|à compléter|à insérer|goes here|einfügen)$")
_FILTER = re.compile(r"\s*\|.*")


def _field_words(name: str) -> list[str]:
    return [w for w in re.split(r"[\s._\-]+", re.sub(r"([a-zà-ÿ])([A-Z])", r"\1 \2", name)) if w]


def _is_field(sign: str, whole: str, name: str) -> bool:
    """Whether what stands between the delimiters has the form of a field's name there."""
    bare = _FILTER.sub("", name).strip(" =-:#/")
    ws = _field_words(bare)
    low = [w.lower() for w in ws]
    if sign.startswith("sure"):
        return sum(c.isalpha() for c in bare) > 1
    if not ws or len(bare) < 2 or len(ws) > 1 and max(map(len, ws)) < 2:
        return False
    joined = "_" in bare or "." in bare.rstrip(".")
    noun = low[-1] in _FIELD_NOUNS
    shape = len(ws) <= 4 and (noun or low[0] in _FIELD_HEADS and len(ws) > 1)
    if sign == "brace":
        letters = [w for w in ws if len(w) > 1 and w.isalpha()]
        return bool(letters) and ("|" in name and " " not in bare or joined and len(letters) > 1 or shape and ("'" not in name))
    if sign == "wiki":
        return bare.isupper() or joined and bare.islower()
    if sign == "square":
        if _PENDING_FIELD.search(name):
            return True
        if "_" in bare and " " not in bare:
            return True
        return shape and (bare.isupper() and (len(ws) > 1 or noun) or all(w[:1].isupper() for w in ws)) and not any(c in name for c in ".,;:!?()'")
    if sign == "angle":
        if low[0] in _ELEMENTS and len(ws) == 1:
            return False
        return bare.isupper() and len(bare) > 2 or len(ws) > 1 and shape and all(w[:1].isupper() for w in ws)
    if sign == "guillemet":
        return bare.islower() and not re.search(r"\w\s*$", whole[:0]) and (noun or joined or len(ws) > 1) and len(ws) <= 4
    if sign == "colon":
        return noun
    return True


_CODE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b.*?</\1>")
_QUOTED = re.compile(r"“(?:[^”\n]|\n(?!\n))*”|„(?:[^“”\n]|\n(?!\n))*[“”]|\"[^\"\n]*\"|«\s(?:[^»\n]|\n(?!\n))*\s»|‹[^›\n]*›|`[^`\n]+`|(?<!\w)‘(?:[^’\n]|’(?=\w)){3,}’(?!\w)")
_BRACKETS = re.compile(r"\((?!most recent|core dumped)[^()\n]*\)|\[[^\[\]\n]*\]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Around placeholders: 'e.g.' ends no sentence, nor does a line break after a colon.
_FIELD_SENTENCE = re.compile(r"(?<=[.!?…])(?<!e\.g\.)(?<!E\.g\.)\s+|(?<![:\n])\n+")
_DIDACTIC = re.compile(
    r"(?i)\b(?:for example|e\.g\.|such as|syntax|tutorial|you can (?:write|use|put)|zum Beispiel|par exemple|por ejemplo|Beispiel(?:e)?:|template engine|(?:placeholders?|templates?|variables?|fields?|tags?|elements?|attributes?|macros?|expressions?|merge fields?)\s+(?:like|such|look|marks?|named|called|is|are|in|of|have|has|expands?|holds?)"
    r"|(?:the|a|an|these|this) (?:\w+ )?(?:placeholders?|templates?|variables?|tags?|elements?|macros?|shell|console|command line)|python|ruby|perl|php|jinja|django|mustache|handlebars|liquid|latex|html|xml|css|markup|javascript|prints?\b|denotes?|stands for|expands to|be a (?:set|sequence|singleton|function)|singleton|subset|sequence of)"
)
_CODE_LINE = re.compile(r"[;{]\s*$|^\s*\}?\s*$(?<=\})|^\s*(?:import|from|def|class|function|var|let|const|public|private|return|#include|SELECT|INSERT)\b.*[;:({=]|^\s*[\w.$]+\s*=\s*[\"'{\[(]|^\s*[\w.]+\(.*\)\s*$|^\s*</?\w+[^<>]*=\s*\"")

# ---- notices

_START = r"(?:(?:the|this|that|our|your|a|an|die|der|das|diese|dieser|dieses|ihre|ihr|la|le|les|l'|cette|ce|votre|el|esta|este|il|lo|questa|questo|o|de|het|deze)\s+)?"
_POLITE = r"(?:(?:sorry|oops|whoops|unfortunately|leider|désolé|lo sentimos|spiacenti|error|fehler|erreur)\W+)?"
_END = r"(?=\s*(?:$|[.:!?|–—\-]))"
_SUBJECT = _trie([*_SERVED, *_SERVED_TOO])
_NOT_LETTER = r"(?<![^\W\d_])"
_B = r"(?![^\W\d_])"
_HEAD = re.compile(
    "|".join(
        (
            # a status with its reason, or a fault's name with its number
            rf"(?:http(?:/\d(?:\.\d)?)?\s+)?(?:(?:error|status|fehler|erreur|errore|erro)\s+)?(?:code\s+)?[45]\d\d\s*[:–—\-,]?\s*(?:{_trie([*_REASONS, *_FAILED])}){_B}",
            rf"(?:{_trie(_FAULT_NAMES)})\s*(?:error|status|fehler|erreur|code|reference|id|nr\.?|no\.?)?\s*[:#/]?\s*\d[\w.\-]*{_END}",
            rf"(?:http\s+)?(?:error|fehler|erreur|errore|erro)\s+\d{{3}}\s*[:–—(]",
            rf"{_POLITE}(?:{_trie(_OUTRIGHT)}){_END}",
            rf"(?:{_trie(_SERVERS)})(?:/[\d.]+)?\s*$",
            rf"{_POLITE}{_START}(?:\w+\s+){{0,2}}?(?:{_SUBJECT})\s+(?:(?:is|are|was|has been|ist|est|es|è|currently|temporarily)\s+)?(?:{_trie(_FAILED)}){_END}",
            rf"{_POLITE}(?:{_trie(w for w in _WRONG if w not in ('oops', 'whoops', 'hoppla'))}){_B}",
            rf"(?:oops|whoops|hoppla|sorry)\s*(?:$|[.:!–—\-])",
            rf"access\s+to\s+(?:this|the)\s+(?:page|site|website|resource|server|file|url|service)\s+(?:has\s+been|is|was)\s+(?:denied|blocked|forbidden|restricted)",
            rf"(?:zugriff|accès|acceso|accesso|acesso|toegang)\s+(?:\w+\s+){{1,4}}(?:verweigert|nicht\s+erlaubt|gesperrt|refusé|interdit|denegado|negato|negado|geweigerd){_END}",
            rf"(?:please\s+)?(?:log|sign)\s+in\s+again\b",
            rf"(?:contact|return\s+to|go\s+back\s+to)\s+(?:the|your)\s+(?:site\s+|system\s+)?(?:administrator|webmaster|home\s?page|start\s?page){_END}",
            rf"connection\s+(?:refused|reset|timed\s+out|closed|lost){_END}",
        )
    )
)
_SYSTEM = re.compile(rf"{_POLITE}{_START}(?:[\w'-]+\s+){{0,3}}?(?:(?P<sure>{_trie(_SERVED)})|(?P<maybe>{_trie(_SERVED_TOO)})){_B}")
_FAILS = re.compile(rf"{_NOT_LETTER}(?:{_trie(_FAILED)}){_B}")
_FAILS_TOO = re.compile(rf"{_NOT_LETTER}(?:{_trie([*_FAILED, *_FAILED_TOO])}){_B}")
_ASKS = re.compile(rf"{_NOT_LETTER}(?:{_trie(_ASKED)}){_B}")
_DENIES = re.compile(rf"{_NOT_LETTER}(?:{_trie(_DENIED)}){_B}")
_HAS_SCRIPT = re.compile(rf"{_NOT_LETTER}(?:{_trie(_SCRIPTS)}){_B}")
_HAS_SWITCH = re.compile(rf"{_NOT_LETTER}(?:{_trie(_SWITCHED)}|(?:turn|switch)\s+[\w\s]{{1,30}}?\bon){_B}")
_BOT = re.compile(rf"{_NOT_LETTER}(?:{_trie(_ROBOTS)}){_B}")
_BOT_HEAD = re.compile(
    rf"{_POLITE}(?:(?:please|click|just|one|checking|verifying|verify|confirm|complete|we\s+(?:have\s+)?(?:detected|believe)|are\s+you|you|your|too\s+many|this\s+(?:site|request|website)|attention|if\s+you|access|solve|ray|überprüf\w*|vérif\w*)\b)"
)
_SCRIPT_HEAD = re.compile(
    rf"{_POLITE}(?:(?:please|kindly|bitte|veuillez|merci|por\s+favor|per\s+favore|si\s+prega|alstublieft|turn|switch|enable|activate|allow|accept|upgrade|update|change|aktivieren|activez|autorisez|habilite|activa|active|abilita|attiva|ative|schakel|you(?:'ll)?|vous\s+devez|sie\s+müssen|debe|deve|devi|to\s+\w+|in\s+order\s+to|um|pour|if|checking|loading|it\s+(?:looks|seems|appears)|we(?:'re)?\s+\w+|your|ihr|votre|su|tu|il\s+tuo|uw)\b"
    rf"|(?:{_trie(_SCRIPTS)}){_B}\s*:?\s*(?:(?:is|are|must|needs?|has|have|ist|muss|müssen|est|doit|doivent|wird|es|está|è|deve|required|disabled|and|the|not|support)\b|:)"
    rf"|(?:the|this|our|diese[rs]?|die|der|das|cette|ce|la|le|esta|este|questa|questo|deze|a|an)\s+(?:[\w'-]+\s+){{1,6}}?(?:requires?|needs?|uses?|benötigt|braucht|erfordert|nécessite|requiert|requiere|necesita|richiede|requer|vereist|works\s+best)\b)"
)
_TRACE = re.compile(
    r"Traceback \(most recent call last\)|\b\w+(?:\.\w+)+(?:Exception|Error)\b|(?m:^\s*\w*(?:Error|Exception): \S)|\b(?:Fatal|Parse|Uncaught|Unhandled) (?:error|exception|\w*Error|\w*Exception)\b[:\s]|\bException in thread\b"
    r"|\bWarning: (?:\w+\(\)|Undefined\b|[^\n]* on line \d)|\bin /[\w.-]+(?:/[\w.-]+)*\.\w+ on line \d|\b(?:ERR|DNS|SSL|NET|PR|SEC|MOZILLA)_[A-Z]+(?:_[A-Z]+)+\b|\bSQLSTATE\[|\bORA-\d{5}\b|\(core dumped\)"
)
#: Someone tells, asks, is told or named: then it is speech about a notice.
_NARRATED = re.compile(
    r"""(?x) \b(?: said | says | say | told | tells | tell | wrote | writes | asked(?!\ for\b) | asks | answered | replied | replies | read\ out | showed | shows | headed | reading | quote | quoted | cite | cited | admitted | argued | argues | explained | explains | complained | claimed | claims | described | describes
    | recalled | remembers | noted | reported | logged\ in | ever\ saw | was\ the\ answer | title\ of | honou?rable | members? | minist(?:er|ry|re) | constituents? | colleagues? | kolleg(?:en|in|innen) | abgeordnete\w* | zitiere | sagte\w* | schrieb\w* | antwortete\w* | sagt | meinte | erklärte | geht\ es | sei
    | (?:a|ont)\ (?:dit|répondu|écrit|expliqué) | on\ a\ répondu | collègues | demande | écrit | dijo | dice | escribió | disse | scrisse | cannot\ do | nothing\ else | before\ you | he | she | they | my | his | her | their | them | him | mein\w* | ich | elles? | ils | ella | ellos | last\ year | last\ week )\b
    | \bby\ (?:the|a|an|his|her|my|our|this)\ (?!page|site|viewer|server|browser|website) | \b(?:1[0-9]|20)\d\d\b(?!\s*[:.–-]) | \bbetween\b """
)
_I = re.compile(r"\bI\b(?!\.)")
#: A reporter's interjection between dashes inside a sentence.
_INTERJECTION = re.compile(r"[–—]\s[^–—\n]+!\s[–—]")
#: Where a new sentence begins without a stop before it.
_RUN_ON = re.compile(r"(?<=[a-zß-ÿ]) (?=(?:I|[A-ZÀ-Þ][a-zß-ÿ’']+,?) [a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"[^\S\n]{2,}|[\t\xa0]")

# ---- filler

_ANNOUNCED = re.compile(
    rf"(?:(?:this|here|that|dies|das|hier|dieser|dieses|ceci|voici|este|esto|questo|dit)\s+)?(?:(?:is|are|ist|steht|wäre|könnte\s+ihr\s+text\s+stehen\W+|est|es|è|follows)\s+)?(?:(?:only|just|nur|seulement|solo)\s+)?(?:(?:a|an|some|the|ein|eine|un|une|una|du|um|een)\s+)?(?:\w+\s+)?(?:{_trie(x for x in _STAND_INS if x != 'lorem ipsum')}){_B}"
)
_TO_COME = re.compile(
    rf"(?:(?:your|the|full|more|some|new|main|body|hier)\s+)*(?:\w+\s+)?(?:(?:{_trie(_PENDING_NOUNS)})\s+)?(?:(?:is|are|ist|est)\s+)?(?:{_trie(x for x in _COMING if x != 'here')})\s*$"
    rf"|(?:insert|add|enter|type|paste|put|write)\s+(?:\w+\s+){{0,3}}?(?:{_trie(_PENDING_NOUNS)})(?:\s+here)?\s*$|(?:your\s+)?(?:{_trie(_PENDING_NOUNS)})\s+here\s*$"
    rf"|(?:coming\s+soon|under\s+construction|(?:this|our)\s+(?:page|site|website)\s+is\s+under\s+construction|próximamente|em\s+breve|in\s+arrivo)\s*$"
)
_MARKS = re.compile(r"(?:(?:tbc|tbd|tba)\b[\s,;:–—-]*){2,}")


def _stretch(words: list[str], period: int) -> int:
    """How many words at the end repeat with the given period."""
    n = period
    while n < len(words) and words[-n - 1] == words[-n - 1 + period]:
        n += 1
    return n if len(words) >= period else 0


def _is_filler(low: str, heads: list[int], ws: list[str], skipped: int) -> bool:
    """``skipped`` words in front of the sentence may be a speaker's name."""
    if ws:
        for period, least in ((1, 4), (2, 6), (3, 9)):
            n = _stretch(ws, period)
            if n >= least and len(ws) - n <= skipped:
                return True
        if ws[-1] in _EMPTY and (n := _stretch(ws, 1)) >= 2 and len(ws) - n <= skipped:
            return True
    if len(ws) >= 2:
        # from some word on that may follow a name, nearly all words are x-words, or pseudo-Latin
        x = latin = chars = long = n = 0
        kinds: set[str] = set()
        for k in range(len(ws) - 1, -1, -1):
            w = ws[k]
            n += 1
            if set(w) == {"x"}:
                x, chars = x + 1, chars + len(w)
            if w in _LATIN:
                latin, long = latin + 1, long + (len(w) > 4)
                kinds.add(w)
            if k <= skipped:
                if n >= 2 and x >= max(2, 0.8 * n) and chars >= 8:
                    return True
                if n >= 3 and latin >= 0.8 * n and len(kinds) >= 2 and long >= 2:
                    return True
    bare = low.rstrip(" .!?…")
    if len(ws) - skipped <= 8 and any(_TO_COME.match(bare, k) for k in heads):
        return True
    if any(_MARKS.match(low, k) for k in heads):
        return True
    return any(_ANNOUNCED.match(low, k) for k in heads) and not _NARRATED.search(low)


def _is_notice(sentence: str, low: str, heads: list[int], n_words: int) -> bool:
    stop = _RUN_ON.search(sentence, heads[-1] + 20)
    end = stop.start() if stop else len(low)
    told = low[:end]
    hit = any(_HEAD.match(low, k) for k in heads)
    if not hit and _HAS_SCRIPT.search(told) and _HAS_SWITCH.search(told):
        hit = any(_SCRIPT_HEAD.match(low, k) for k in heads)
    if not hit and _BOT.search(told):
        hit = any(_BOT_HEAD.match(low, k) for k in heads)
    if not hit and (asked := _ASKS.search(told)):
        hit = _DENIES.search(told, asked.end()) is not None or _FAILS.search(told) is not None
    if not hit and _FAILS_TOO.search(told):
        for k in heads:
            if m := _SYSTEM.match(told, k):
                own = told[m.end() :]
                sure = m.group("sure") is not None or re.search(r"\b(?:your|ihre|votre) ", m.group()) is not None
                if (_FAILS_TOO if sure else _FAILS).search(own) and (sure or n_words <= 12):
                    hit = True
                    break
    return hit and not _NARRATED.search(told) and not _I.search(sentence[:end])


def _heads(s: str) -> tuple[list[int], int]:
    """Where the sentence may begin: at its first word, or after a speaker's name or other capitalised words in front;
    and how many words those are."""
    heads, words = [], 0
    at = 0
    while at < len(s):
        while at < len(s) and not (s[at].isalnum() or s[at] in "[(«"):
            at += 1
        heads.append(at)
        stop = at
        while stop < len(s) and not s[stop].isspace():
            stop += 1
        if stop >= len(s) or not (s[at].isupper() or s[at].isdigit() and not s[at:stop].isdigit() or not s[at].isalnum()):
            break
        words += len(_LETTERS.findall(s[at:stop]))
        at = stop
    return heads or [0], words


def _left_over_field(spoken: str) -> bool:
    """Whether there is a placeholder outside the sentences that explain placeholders and outside code."""
    stops = lines = None
    for m in _FIELD.finditer(spoken):
        if not _is_field(m.lastgroup, m.group(), next(g for g in reversed(m.groups()) if g is not None)):
            continue
        if stops is None:
            stops = [s.span() for s in _FIELD_SENTENCE.finditer(spoken)]
            lines = [bool(_CODE_LINE.search(x)) for x in spoken.split("\n") if x.strip()]
        if sum(lines) * 2 > len(lines):
            return False
        at, rest = bisect_right(stops, (m.start(), len(spoken))), bisect_left(stops, (m.end(), 0))
        begin, end = stops[at - 1][1] if at else 0, stops[rest][0] if rest < len(stops) else len(spoken)
        line = spoken[spoken.rfind("\n", 0, m.start()) + 1 : (spoken.find("\n", m.end()) + 1 or len(spoken) + 1) - 1]
        if not _DIDACTIC.search(spoken[begin : m.start()] + " \x00 " + spoken[m.end() : end]) and not _CODE_LINE.search(line):
            return True
    return False


#: What must follow a trigger for it to count; the trigger itself lies just before.
_STOPS = re.compile(r"\s*(?:$|[.:!?…|\n–—\-])")
_NUMBERED = re.compile(r"\s*(?:error|status|fehler|erreur|code|reference|id|nr\.?|no\.?)?\s*[:#/]?\s*\d|:|(?<=\w(?:error))(?!\w)")


@lru_cache(maxsize=1)
def _triggers():
    """One automaton of all the rules' vocabularies: a sentence without any of these, without repeated or x-words,
    fields and traces, meets no rule. Each trigger comes with what must follow it, if anything."""
    import ahocorasick

    words: dict[str, re.Pattern | None] = {w: _NUMBERED for w in _FAULT_NAMES}
    words |= {w: _STOPS for w in (*_COMING, "sorry", "oops", "whoops", "hoppla", *(f"{w}" for w in _PENDING_NOUNS))}
    free = [
        *_OUTRIGHT, *_REASONS, *_SERVERS, *_FAILED, *_ASKED, *_SCRIPTS, *_ROBOTS, *(w for w in _WRONG if w not in ("oops", "whoops", "hoppla")), *_STAND_INS, "tbc", "tbd", "tba", "xx", "zugriff", "accès", "acceso", "accesso", "acesso", "toegang",
        *(w for w in _SERVED if w not in ("server", "dns")), "server ", "servers ", "server.", "dns ", *(w for w in _LATIN if len(w) > 4), *(f"{a} {b}" for a in ("your", "ihre", "votre") for b in _SERVED_TOO),
        *(f"access to {w} {x}" for w in ("this", "the") for x in ("page", "site", "website", "resource", "server", "file", "url", "service")),
        *(f"{v} {w}" for v in ("contact", "return to", "go back to") for w in ("the site administrator", "the system administrator", "the administrator", "the webmaster", "the home page", "the homepage", "the start page", "your administrator", "your system administrator")),
        "traceback (most", "exception", "fatal error", "parse error", "uncaught", "unhandled", "warning: ", "err_", "dns_", "ssl_", "net_", "pr_", "sec_", "mozilla_", "sqlstate[", "ora-", "core dumped", " on line ",
    ]
    words |= dict.fromkeys(free)
    automaton = ahocorasick.Automaton()
    for w, follows in words.items():
        automaton.add_word(w, follows)
    automaton.make_automaton()
    return automaton


def _triggered(low: str) -> bool:
    return any(follows is None or follows.match(low, end + 1) for end, follows in _triggers().iter(low))


def _repeats(ws: list[str]) -> bool:
    """Whether any stretch of the words repeats as the filler rules ask for."""
    alike = bytes(map(eq, ws, ws[1:]))
    at = alike.find(1)
    while at >= 0:
        if ws[at] in _EMPTY:
            return True
        at = alike.find(1, at + 1)
    return b"\1" * 3 in alike or b"\1" * 4 in bytes(map(eq, ws, ws[2:])) or b"\1" * 6 in bytes(map(eq, ws, ws[3:]))


def _plain_blanks(low: str) -> str:
    return _BLANKS.sub(" ", low) if "  " in low or "\t" in low or "\xa0" in low else low


def kinds(text: str) -> list[str]:
    """What residue a text holds: ``placeholder``, ``filler``, ``notice``; empty if none."""
    low = _plain_blanks(text.lower().replace("’", "'"))
    told, field, again = _triggered(low), _FIELD_SIGN.search(text) is not None, _repeats(_LETTERS.findall(low))
    if not (told or field or again):
        return []
    found = []
    plain = _CODE.sub(" ", text) if "```" in text or "~~~" in text or "</" in text else text
    spoken = _QUOTED.sub(" ", plain)
    if field and _left_over_field(spoken):
        found.append("placeholder")
    if not (told or again):
        return found
    filler, notice = False, _TRACE.search(spoken) is not None
    # bracketed remarks are the reporter's; what they hold is no case
    for sentence in _SENTENCE.split(_INTERJECTION.sub(" ", _BRACKETS.sub(" ", spoken)).replace("’", "'")):
        low = sentence.lower()
        ws = None
        if not _triggered(_plain_blanks(low)) and not (again and _repeats(ws := _LETTERS.findall(low))):
            continue
        ws = _LETTERS.findall(low) if ws is None else ws
        heads, skipped = _heads(sentence) if len(low) == len(sentence) else ([0], 0)
        filler = filler or _is_filler(low, heads, ws, skipped)
        notice = notice or _is_notice(sentence, low, heads, len(ws))
        if filler and notice:
            break
    return found + ["filler"] * filler + ["notice"] * notice


def find_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``kinds``): the documents that hold residue, with its kinds.

    Null and empty texts hold none. Whole texts are read, however long. Repeated rows are judged each by itself.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            judged = [(d, k) for d, t in zip(b["doc_id"], b["text"]) if (k := kinds(t))]
            yield pd.DataFrame(judged, columns=["doc_id", "kinds"])

    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return texts.mapInPandas(run, f"doc_id {kind}, kinds array<string>")
