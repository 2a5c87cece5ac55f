"""Template residue, filler, error pages and script notices told from real text (problem 1).

Character n-gram models are compared along each text: models of filler, of notices (error pages, blocking pages, scripts)
and of templates, fitted to the seeds below and mixed, and one of natural prose, counted over the texts of the
corpus; a text that is copied often (numbers, nonces and case aside) weighs little more than one, else it became prose.
Windows of the log-likelihood ratio localise residue; a text is excluded when residue covers it.  A short exact check
follows: what isn't covered must not hold a run of prose.

Cases: null, blank, emoji-only and merely short texts aren't residue; texts that report or quote such a message are
covered only in part and stay; letter case and a wrapping of mark-up don't matter; whole texts are scored, whatever
their length; repeated rows are scored alike; an empty table gives no rows; `has_user_text` isn't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.session import table

BUCKETS = 1 << 17
WINDOW = 11
#: Share of the decided letters that residue must cover, and the longest run of prose letters that may be left.
COVERAGE, PROSE_RUN = 0.5, 14
#: Letters that residue must cover at least; an unfilled place counts as ten.
LEAST_LETTERS = 8
_VAR, _NONCE, _TAG = "", "", ""

#: Texts to fit the model of residue; a parameter of :func:`fit_residue`. ``{v}`` stands for an unfilled place.
FILLER = """lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
lorem ipsum lorem ipsum nisio magnam commod elitur incidu tempora nostra labora adipi ullam aliqua veniam sedum
placeholder text placeholder paragraph number 00, do not ship. this is placeholder content. placeholder for description.
sample review text, replace before publishing (000). sample text. example text, to be replaced. replace this text. dummy text. dummy content for layout check 000
your text here ... your text goes here. text goes here. insert description here. insert description. insert text here. add your content here. enter your text. write something here.
body text body text body text. heading goes here. title goes here. content goes here. description goes here. coming soon.
todo: write body todo: write text todo: add description todo tbd tba fixme content to follow. to be written.
test test test 00 test 000 testing testing 123 this is a test post please ignore
asdf asdf asdfasdf asdf jkl qwerty qwerty qwertz uiop zxcv zxcvbn hjkl sdfg dfgh fghj ghjk xxxxx xxxxx xxxxxx xxx aaaa bbbb foo bar baz
blindtext: hier steht später der inhalt (000). platzhaltertext. beispieltext, bitte ersetzen. hier steht ein text. text folgt. mustertext für das layout.
texte d'exemple, à remplacer (000). texte de remplissage. votre texte ici. contenu à venir. faux texte pour la mise en page.
texto de ejemplo, reemplazar antes de publicar. texto de relleno. escriba aquí su texto. contenido de prueba.
texto de exemplo, substituir antes de publicar. seu texto aqui. conteúdo de teste.
testo di esempio, da sostituire. testo segnaposto. inserire qui il testo. voorbeeldtekst, vervangen. plaats hier uw tekst. opvultekst.
пример текста, заменить. текст-заполнитель. здесь будет текст. これはダミーテキストです。ここに本文が入ります。サンプルテキスト。"""
NOTICES = """<html><head><title></title></head><body><h1></h1><p></p></body></html> <html><body><h1>not found</h1></body></html>
please enable javascript to view this content. you need to enable javascript to run this app. javascript is required. javascript is disabled in your browser. turn it on and reload. please turn on javascript and refresh the page.
this site requires scripts. your browser does not run them, so reviews cannot be shown. scripts blocked. to read this thread, allow scripting and cookies, then refresh. your browser is not supported. switch scripting on to load replies. enable cookies to continue. this page needs scripting.
bitte aktivieren sie javascript, um die bewertungen zu sehen. diese seite benötigt javascript. javascript ist deaktiviert. ihr browser wird nicht unterstützt.
veuillez activer javascript pour afficher cette page. javascript est désactivé dans votre navigateur. votre navigateur n'est pas pris en charge.
debes habilitar javascript para ver este hilo. activa javascript para continuar. su navegador no es compatible. ative o javascript para continuar. é necessário ativar o javascript. seu navegador não é compatível.
abilita javascript per continuare. attiva javascript per visualizzare questa pagina. schakel javascript in om deze pagina te bekijken. javascript is vereist. uw browser wordt niet ondersteund.
для просмотра включите javascript в браузере. включите javascript. ваш браузер не поддерживается. このページを表示するには javascript を有効にしてください。お使いのブラウザはサポートされていません。
error 000: page not found. 404 not found. the requested page was not found. 403 forbidden. 500 internal server error at handler (00) at dispatch (00). 502 bad gateway edge node nginx. 503 service unavailable. 504 gateway timeout. the server is temporarily unable to handle the request. ref. service unavailable.
upstream connect error or disconnect before headers. reset reason: connection failure. {"error":{"code":000,"message":"backend timeout","trace":""}} {"error":"internal error","status":500}
access denied. you don't have permission to view this resource. reference # you do not have permission to access this page. request blocked. your ip has been blocked.
too many requests (000). please slow down and retry in 00 seconds. rate limit exceeded. unusual traffic was detected from your network. confirm that you are not a robot. verify you are human. checking your browser before you continue. this takes about 0 seconds. ray complete the captcha.
sorry, something went wrong on our end. request id please try again later. an unexpected error has occurred. this page isn't available right now. try again later. this content is not available. this page has been removed or moved.
we'll be back soon! the site is down for maintenance until 00:00. site under maintenance. your session has expired. please log in again. sign in to continue to the community. you must be logged in to view this page. log in to continue. loading, please wait.
fehler 000 - die angeforderte seite wurde nicht gefunden. seite nicht gefunden. zugriff verweigert. interner serverfehler. dienst nicht verfügbar. bitte versuchen sie es später erneut. ihre sitzung ist abgelaufen. bitte melden sie sich an.
erreur 000 : cette page est introuvable ou a été déplacée. page introuvable. accès refusé. erreur interne du serveur. service indisponible. veuillez réessayer plus tard. votre session a expiré. connectez-vous pour continuer.
error 000. la página solicitada no existe. página no encontrada. acceso denegado. error interno del servidor. servicio no disponible. inténtelo de nuevo más tarde. su sesión ha caducado. inicia sesión para continuar.
erro 000. página não encontrada. a página solicitada não existe. acesso negado. serviço indisponível. tente novamente mais tarde. sua sessão expirou. entre para continuar.
errore 000. pagina non trovata. la pagina richiesta non esiste. accesso negato. servizio non disponibile. riprova più tardi. la sessione è scaduta. fout 000. pagina niet gevonden. de opgevraagde pagina bestaat niet. toegang geweigerd. probeer het later opnieuw. uw sessie is verlopen.
ошибка 000. страница не найдена. доступ запрещён. внутренняя ошибка сервера. сервис недоступен. попробуйте позже. сессия истекла. ページが見つかりません (000) アクセスが拒否されました。サーバーエラーが発生しました。しばらくしてからもう一度お試しください。"""
TEMPLATES = """hello {v}! your thread {v} was answered on {v}. hi {v}, thank you for rating {v}. dear {v}, we are sorry to hear about {v}. please open {v} for details. thanks {v}, we received your message about {v}.
{v} rated this {v} out of 5 review of {v} by {v}: {v} title: {v} body: {v} rating: {v} {v} - {v} we saw that {v} on {v} stopped working. reply to {v}. your order {v} has shipped to {v}. welcome to {v}, {v}. dear customer {v}
hallo {v}, danke für deine bewertung von {v}. bonjour {v}, merci pour votre avis sur {v}. hola {v}, gracias por tu opinión sobre {v}. olá {v}, obrigado pela sua avaliação de {v}. ciao {v}, grazie per la tua recensione di {v}. hallo {v}, bedankt voor je beoordeling van {v}. здравствуйте, {v}, спасибо за отзыв о {v}. {v}様、{v}のレビューをありがとうございます。"""

_PLACE = re.compile(
    r"\{\{[^{}\x00\n]{1,40}\}\}|\{%[^%{}\x00\n]{1,40}%\}|[$#]\{[^{}\x00\n]{1,40}\}|\[\[[^\[\]\x00\n]{1,40}\]\]|<%=?[^%<>\x00\n]{1,40}%>|%[a-z][a-z0-9_. ]{1,38}[a-z0-9]%|@@[a-z][a-z0-9_. ]{1,38}@@"
    r"|__[a-z][a-z0-9_. ]{0,36}[a-z0-9]__|<[a-z]+[._][a-z._]{1,38}>|<(?:rating|product|author|locale|date|user|name|email|text|order|customer\w*)>|\[(?:insert|your|enter|add|name|date)\b[^\[\]\x00\n]{0,40}\]|%\([a-z_]+\)[sd]|%[sd]\b"
)
_MARK = re.compile(r"<br\s*/?>|&nbsp;")
_TAGS = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|div|span|center|hr|pre|b|i|em|strong)(?:\s[^<>\x00]{0,80})?/?>")
_HEX = re.compile(r"\b(?=[a-z0-9]*\d)[0-9a-f]{5,32}\b|\b[0-9a-f]{6,8}\b(?=\)|\]|\s*\x00)")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_BLANKS = re.compile(r"[^\S\x00]+")


def _simplify(joined: str) -> str:
    """Case folded text with unfilled places, nonces, mark-up and numbers as single signs; \\x00 parts the texts."""
    s = _BLANKS.sub(" ", _MARK.sub("\n", joined.lower()))
    s = _PLACE.sub(_VAR, s) if any(x in s for x in ("{", "[", "%", "@@", "__", "<")) else s
    s = _TAGS.sub(_TAG, s) if "<" in s else s
    return _DIGITS.sub("0", _HEX.sub(_NONCE, s))


def _signs(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)


def _trigrams(c: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that ends at each position; before the start of a text there are only signs of a start."""
    h = c.astype(np.uint64) * np.uint64(0x9E3779B1)
    h[1:] += c[:-1].astype(np.uint64) * np.uint64(0x85EBCA6B)
    h[2:] += np.where(c[1:-1] == 0, 0, c[:-2]).astype(np.uint64) * np.uint64(0xC2B2AE35)  # not across the start of a text
    h ^= h >> np.uint64(15)
    h *= np.uint64(0x2545F491)
    return ((h >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64)


def _join(texts) -> str:
    return "\x00" + "\x00".join(t.replace("\x00", " ") if t else "" for t in texts) + "\x00"


def count_prose(texts: DataFrame) -> np.ndarray:
    """Trigram counts over the simplified texts, where a text with n copies weighs 1 + log2(n).

    So copies don't turn residue into prose, while prose that is repeated remains prose.  One array per partition, summed
    by bucket; ``BUCKETS`` numbers reach the driver.
    """

    def simplify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by = Counter(_simplify(_join(b.iloc[:, 0])).split("\x00")[1:-1])
            yield pd.DataFrame({"s": list(by), "n": list(by.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS)
        for b in batches:
            c = _signs(_join(b["s"]))
            weight = np.r_[1 + np.log2(b["n"].to_numpy(np.float64)), 0][np.cumsum(c == 0) - 1]
            total += np.bincount(_trigrams(c)[c != 0], weights=weight[c != 0], minlength=BUCKETS)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k.astype(np.int32), "n": total[k]})

    copies = texts.mapInPandas(simplify, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    rows = copies.mapInPandas(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


KINDS = ("filler", "notice", "template")


def fit_residue(prose: np.ndarray, seeds: dict[str, str] | None = None) -> np.ndarray:
    """Log-likelihood ratios of each trigram over prose: a model for each kind of residue, and first that of their mixture.

    The models are fitted apart and mixed by the size of their seeds; all are smoothed with the same floor.  ``seeds`` has
    the texts of each of ``KINDS``.
    """
    seeds = seeds or dict(zip(KINDS, (FILLER, NOTICES, TEMPLATES)))
    floor, models, sizes = 2e-6, [], []
    for kind in KINDS:
        lines = [part.replace("{v}", _VAR) for line in seeds[kind].split("\n") for part in (line, *re.split(r"(?<=[.!?。]) ", line))]
        c = _signs(_simplify("\x00" + "\x00".join(lines) + "\x00"))
        n = np.bincount(_trigrams(c)[c != 0], minlength=BUCKETS).astype(float)
        models.append(n / max(1, n.sum()))
        sizes.append(n.sum())
    q = np.log(prose / max(1, prose.sum()) + floor)
    return np.clip([np.log(p + floor) - q for p in (np.average(models, axis=0, weights=np.maximum(sizes, 1)), *models)], -4, 4).astype(np.float32)


_ONE_WORD = re.compile(r"\s*[^\W\d_]{1,20}[.!?\s]*")


def coverage(texts, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: share of its decided letters that residue covers, longest run of prose letters, letters in residue."""
    s = _simplify(_join(texts))
    c = _signs(s)
    ends = np.flatnonzero(c == 0)
    n = len(ends) - 1
    score = ratio[0][_trigrams(c)]
    score[c == 0] = 0
    # Window sums: from half a window before to half a window after, within the text.
    total = np.concatenate([[0], np.cumsum(score, dtype=np.float64)])
    owner = np.cumsum(c == 0) - 1  # the text of each position; separators belong to the text after them
    at, half = np.arange(len(c)), WINDOW // 2
    first, last = ends[np.clip(owner, 0, n - 1)] + 1, ends[np.clip(owner + 1, 1, n)]
    low, high = np.maximum(at - half, first), np.minimum(at + half + 2, last)
    mean = (total[np.maximum(high, low)] - total[low]) / np.maximum(1, high - low)
    letter = ((c > 64) & (c != ord("_")) & ~((c >= 91) & (c <= 96)) & ~((c >= 123) & (c <= 191)) & ~((c >= 0x2000) & (c <= 0x2BFF)) & ~((c >= 0x3000) & (c <= 0x303F)) & ~((c >= 0xFE00) & (c <= 0xFE0F)) & (c < 0x1F000)) | (c == 0xE000)
    letter = (letter & (c != 0xE001)) | (c == 0xE002)
    weight = letter + 9 * (c == 0xE000)
    pos, neg = (mean > 0.15) & letter, (mean < -0.15) & letter
    by = lambda m: np.add.reduceat((m * weight).astype(np.int64), ends[:-1])[:n] if n else np.zeros(0, np.int64)
    p, q = by(pos), by(neg)
    # Runs of prose: letters in a row (signs between don't end a run) that aren't won by residue.
    prose = np.cumsum(neg)
    base = np.maximum.accumulate(np.where(pos | (c == 0), prose, 0))
    run = np.maximum.reduceat(prose - base, ends[:-1])[:n] if n else np.zeros(0, np.int64)
    return p / np.maximum(1, p + q), run, p


def is_residue(texts: pd.Series, ratio: np.ndarray) -> np.ndarray:
    share, run, letters = coverage(texts, ratio)
    found = (share >= COVERAGE) & (run <= PROSE_RUN) & (letters >= LEAST_LETTERS)
    for i in np.flatnonzero(found):  # a lone word is merely short
        found[i] = not _ONE_WORD.fullmatch(texts.iloc[i])
    return found


def kinds_of(texts: list[str], ratio: np.ndarray) -> list[str]:
    """The kind of residue whose model likes each text best."""
    out = []
    for t in texts:
        c = _signs(_simplify(_join([t])))
        out.append(KINDS[int(ratio[1:, _trigrams(c)[c != 0]].sum(1).argmax())])
    return out


def residue_model(items: DataFrame, column: str = "text") -> np.ndarray:
    return fit_residue(count_prose(items.select(column).filter(F.col(column).isNotNull())))


def flag_residue(items: DataFrame, column: str = "text", out: str = "is_residue", ratio: np.ndarray | None = None) -> DataFrame:
    """Add a flag to each record; ``ratio`` is a fitted model (some 2 MB, of fixed size), by default fitted here."""
    model = items.sparkSession.sparkContext.broadcast(residue_model(items, column) if ratio is None else ratio)

    def flag(texts: pd.Series) -> pd.Series:
        return pd.Series(is_residue(texts, model.value)) if len(texts) else pd.Series([], dtype=bool)

    return items.withColumn(out, F.pandas_udf(flag, "boolean").asNondeterministic()(F.col(column)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text")
    return flag_residue(items).filter("is_residue").select("raw_record_id")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are residue, each with its kind: filler, notice (error pages among them) or template."""
    items = table(spark, sf_dir, "collected_item").select("raw_record_id", "text")
    ratio = residue_model(items)
    model = spark.sparkContext.broadcast(ratio)

    def kind(texts: pd.Series) -> pd.Series:
        return pd.Series(kinds_of(texts.tolist(), model.value), dtype=object)

    found = flag_residue(items, ratio=ratio).filter("is_residue")
    return found.select("raw_record_id", F.pandas_udf(kind, "string")("text").alias("kind"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source with the number that is kept out as residue."""
    items = table(spark, sf_dir, "collected_item").select("source", "text")
    return flag_residue(items).groupBy("source").agg(F.count("*").alias("records"), F.count_if("is_residue").alias("residue"))


def without_residue(items: DataFrame, column: str = "text") -> DataFrame:
    """The records that aren't residue; a filter for the stage that makes items of records."""
    return flag_residue(items, column, "__residue").filter(~F.coalesce("__residue", F.lit(False))).drop("__residue")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that may become items, as far as residue goes."""
    return without_residue(table(spark, sf_dir, "collected_item").select("raw_record_id", "source", "text")).select("raw_record_id", "source")


QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_clean": p1_clean, "p1_kept": p1_kept}
