"""Problem 4: main content of web pages, by a tree-structured graphical model.

A page is a tree: the page, its sections (chunks), their blocks.  Each node is main body or furniture.
Blocks have unary potentials from a classifier of their words and shape; parent and child are tied by
potentials; sum-product messages run upward from blocks to sections to the page and downward again and
give every block the marginal probability of being main body.

Labelled pages train the model.  A bounded sample of pages is labelled by two witnesses: a classifier of hand-labelled
furniture in several languages against titles and body text of sources that have no furniture (books, notes),
and one of all blocks of the pages against those sources.  A block is furniture if the first is sure of it, or
if the sources hold nothing like it and the first is not sure of the opposite; body if the first is sure of
that; lists with a mark on every line are body.  Messages are sums of logarithms, so a page of any size costs one
aggregation over small columns, with partial sums before the shuffle, and no page is gathered in a task.

Defined results: null, empty and blank texts have no blocks to judge; a blank block is furniture only
if its page says so; repeated rows of a chunk count once; without body text to learn from, the shape alone decides.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.encoding import without_model
from quire.runtime import checkpointed, ship

#: Greatest numbers of rows that the classifier is fitted on: body texts, titles, blocks of the pages.
BODY_ROWS, TITLE_ROWS, PAGE_ROWS = 3_000, 1_000, 4_000
#: Log odds beyond which the hand labels are sure, and beyond which they outweigh that the sources hold nothing like a block;
#: greatest probability of a block, under the sources, that counts as nothing like it.
BUCKETS, SURE, DOUBT, UNLIKE = 1 << 15, 3.5, 2.5, 0.04
#: Parent-child potentials before training: probability that a section is of the page's kind, that a block is of
#: its section's; and the range within which training may set them.
PAGE_SECTION, SECTION_BLOCK, LEAST_TIE, MOST_TIE = 0.55, 0.60, 0.50, 0.90

# Hand-labelled furniture; {t} stands for a title, {s} a site, {p} a place, {n} a number, {d} a date.
FURNITURE = {
    "en": [
        "We use cookies to make this site work. By going on you agree to our privacy policy. Accept", "This site stores cookies on your device. Accept all Reject all Manage choices", "Your privacy matters to us. Choose which cookies we may set: Necessary · Statistics · Marketing. OK", "{s} and {n} partners process data from your browser. Accept all Reject all Manage choices Read our privacy policy",
        "{s}, {n} Quay Lane, {p}. Open Tuesday to Sunday. Registered charity no. {n}. Site by Studio", "Opening hours Mon–Fri 9–17, last entry 16:30. Tickets {n}. Groups by arrangement.", "Sign up for our newsletter. Enter your e-mail address. Subscribe", "Enjoying this? {s} depends on gifts from readers. Give {n} today and help to keep it free.",
        "You are here: Home > News > {t}", "You are here: Home > Collections > {t}", "Tags: News, Events, {p}, archive, {n}   Filed under Collections", "archive bread castle dance engine forest garden history island journal",
        "Who we are: {s} is run by a small team of editors and supported by {n} subscribers. Contact us with corrections.", "An independent site, online since {n}, {s} reaches readers in many countries; send us your suggestions and corrections.", "Sponsored: our members are reading {t} this week, which subscribers can open free of charge.", "Paid content. Members get full access to {t} at no extra cost; try it without charge until the end of {n}.",
        "Coming soon: {t}. Save the date, invite a colleague, and join us in the museum hall in {p}.", "Upcoming event at {p}: {t}. Put it on your list, bring your friends, and come to the reading club.", "Popular now 1. {t} 2. {t} 3. {t}", "Trending: {t} | {t} | {t}",
        "You may also enjoy {t} ({n} min) {t} ({n} min)", "More on this topic: {t} / {t}", "Older post: {t}   Newer post: {t}", "All content copyright {n} {s}. Do not copy without written permission. Accessibility. Last updated {d}.",
        "Print this article  Share by e-mail  {n} likes  {n} comments", "Leave a comment. {n} replies, oldest first. Flag a reply", "Sign in | Create account | Cart ({n}) | Help", "Jump to navigation  Jump to search  Font size + -  Languages: English Español",
        "Find us on: Podcast · Photos · RSS    Return to top", "Special offer: {t}, now as a hardcover, ships free from our store.", "atlas bridges coins dunes flags gulls herbs inns kites lanterns mills nets oars",
    ],
    "de": [
        "Diese Website speichert Daten auf Ihrem Gerät. Alle annehmen Ablehnen Einstellungen", "Wir verwenden Cookies. Mit der weiteren Nutzung stimmen Sie der Datenschutzerklärung zu. Einverstanden", "Sie sind hier: Start » Sammlung » {t}", "Schlagwörter: Lehre, Archiv, {p}",
        "Öffnungszeiten Di–So 10–17 Uhr. Eintritt {n} Euro.", "Nach oben", "Vorheriger Beitrag: {t}   Nächster Beitrag: {t}", "Anzeige. {t} — jetzt im Buchhandel.",
        "Meistgelesen 1. {t} 2. {t}", "Über diese Seite: {s} wird ehrenamtlich betreut; schreiben Sie uns, wenn Sie einen Fehler finden.", "Gefällt Ihnen unser Angebot? {s} braucht Ihre Spende; mit {n} Euro helfen Sie uns.", "Vorschau: {t}. Termin jetzt vormerken und Freunde einladen.",
        "Mehr zum Thema: {t} / {t}", "Rundbrief abonnieren: Ihre E-Mail-Adresse. Abschicken", "© {n} {s} | Kontakt | Impressum | Datenschutz", "Nachdruck nur mit Genehmigung. {s}, {p}. Stand: {d}",
        "Einloggen | Konto anlegen | Merkliste ({n})", "Artikel teilen · weiterleiten · {n} Antworten", "Wir verwenden Cookies, um unser Angebot zu messen. Auswahl ändern Zustimmen", "Cookies helfen uns, diese Seite für Sie zu verbessern. Alle zulassen Mehr zum Datenschutz", "Wir setzen Cookies ein, um Ihnen die Nutzung zu erleichtern. Einstellungen Alle annehmen Datenschutzerklärung lesen",
    ],
    "fr": [
        "Nous utilisons des témoins de connexion pour mesurer l’audience. Tout accepter Refuser Paramètres", "En poursuivant votre navigation, vous acceptez la politique de confidentialité de {s}. Accepter Refuser", "Partager  Imprimer  Envoyer  {n} commentaires", "Vous êtes ici : Accueil › Collections › {t}",
        "Prochainement : {t}. Réservez la date.", "Mots-clés : Projets, Archives, {p}", "Horaires : du mardi au dimanche, de 10 h à 17 h. Entrée {n} euros.", "Haut de page",
        "Publicité. {t} — en librairie.", "Article précédent : {t}   Article suivant : {t}", "Les plus lus 1. {t} 2. {t}", "À propos de ce site : {s} est tenu par des bénévoles ; écrivez-nous pour signaler une erreur.",
        "Ce site vous plaît ? {s} a besoin de vous : un don de {n} euros nous aide.", "À venir : {t}. Notez la date et invitez vos amis.", "{s} existe par vos dons. Avec {n} euros, vous aidez le site à rester ouvert à tous.", "Sur le même sujet : {t} / {t}", "Abonnez-vous à notre bulletin. Votre courriel. Envoyer",
        "© {n} {s} – Crédits – Confidentialité – Contact", "Reproduction interdite sans autorisation. {s}, {p}. Page mise à jour le {d}", "Se connecter | S’inscrire | Mon panier ({n})", "Partager cet article  Envoyer à un ami  {n} réponses",
    ],
    "es": [
        "Usamos cookies propias y de terceros para mejorar su visita. Aceptar Rechazar Configurar", "Si continúa navegando, acepta la política de privacidad de {s}. Rechazar Configurar Aceptar", "Compartir  Imprimir  Guardar  {n} comentarios", "También le puede interesar: {t} / {t}",
        "Está en: Inicio > Noticias > {t}", "Próximamente: {t}. Reserve la fecha.", "Etiquetas: Noticias, Proyectos, {p}", "Horario: de martes a domingo, de 10 a 17. Entrada {n} euros.",
        "Publicidad. {t} — ya en librerías.", "Anterior: {t}   Siguiente: {t}", "Lo más leído 1. {t} 2. {t}", "Sobre este sitio: {s} lo mantienen voluntarios; escríbanos si encuentra un error.",
        "Ayúdenos: {s} depende de sus lectores; con {n} euros puede colaborar.", "Agenda: {t}. Apunte la fecha e invite a sus amigos.", "Más sobre este tema: {t} / {t}", "Reciba nuestro boletín. Su correo electrónico. Suscribirse",
        "© {n} {s}. Aviso legal | Privacidad | Contacto", "Prohibida la reproducción sin permiso. {s}, {p}. Actualizado el {d}. Arriba", "Iniciar sesión | Crear cuenta | Carrito ({n})", "Comparta este artículo  Envíe por correo  {n} respuestas",
    ],
    "pt": [
        "Usamos cookies para melhorar a sua visita. Aceitar Rejeitar", "Assine o boletim. Escreva o seu e-mail. Enviar", "© {n} {s}. Todos os direitos reservados. Aviso legal | Mapa do site", "Entrar | Registar | Cesto ({n})",
        "Partilhar  Imprimir  Guardar  {n} comentários", "Também lhe pode interessar: {t} / {t}", "Está em: Início > Notícias > {t}",
    ],
    "pl": [
        "Ta strona używa plików cookie. Akceptuj wszystkie Odrzuć", "Zapisz się na biuletyn. Podaj adres e-mail. Wyślij", "© {n} {s}. Wszelkie prawa zastrzeżone. Regulamin | Mapa strony", "Zaloguj | Zarejestruj | Koszyk ({n})",
        "Udostępnij  Drukuj  Zapisz  {n} komentarzy", "Zobacz także: {t} / {t}", "Jesteś tutaj: Start > Zbiory > {t}",
    ],
    "ru": [
        "Мы используем файлы cookie. Принять все Отклонить", "Подпишитесь на рассылку. Введите адрес почты. Отправить", "© {n} {s}. Все права защищены. Условия | Карта сайта", "Войти | Регистрация | Корзина ({n})",
        "Поделиться  Печать  Сохранить  {n} комментариев", "Читайте также: {t} / {t}", "Вы здесь: Главная > Новости > {t}",
    ],
    "zh": [
        "本网站使用 Cookie。全部接受 拒绝", "订阅我们的通讯。输入电子邮件地址。提交", "© {n} {s} 版权所有 使用条款 | 隐私 | 网站地图", "登录 | 注册 | 购物车 ({n})",
        "分享 打印 收藏 {n} 条评论", "相关文章：{t} / {t}",
    ],
    "ja": [
        "このサイトはクッキーを使用します。すべて許可 拒否", "ニュースレターに登録。メールアドレスを入力。送信", "© {n} {s} 無断転載を禁じます 利用規約 | プライバシー | サイトマップ", "ログイン | 登録 | カート ({n})",
        "共有 印刷 保存 コメント {n} 件", "関連記事：{t} / {t}",
    ],
}
# Words of menus.
MENUS = {
    "en": "Home About Contact News Events Blog Shop Projects People Collections Archive Data Publications Visit Members Careers Map Teaching Gallery Research Library Press Help Search|Support us".replace("|", "\n").split("\n"),
    "de": ["Start Kontakt Aktuelles Sammlung Archiv Lehre Mitglieder Projekte Shop Veranstaltungen Presse Forschung Hilfe Suche", "Über uns"],
    "fr": ["Accueil Contact Actualités Collections Archives Projets Boutique Carte Équipe Adhérer Agenda Recherche Aide", "À propos"],
    "es": ["Inicio Contacto Noticias Colecciones Archivo Proyectos Tienda Mapa Equipo Socios Agenda Prensa Ayuda", "Quiénes somos"],
    "pt": ["Início Contacto Notícias Coleções Arquivo Projetos Loja Mapa Equipa Sócios Agenda", "Quem somos"],
    "pl": ["Start Kontakt Aktualności Zbiory Archiwum Projekty Sklep Mapa Zespół Wydarzenia", "O nas"],
    "ru": ["Главная Контакты Новости Коллекции Архив Проекты Магазин Карта События", "О нас"],
}
# Hand-labelled body sentences that use the words of furniture.
BODY = [
    "The society kept a register of members, and a contact with the archive was made through its library.", "Cookie notices and privacy policies changed how readers look at a page, as the second survey shows.", "He was the first to subscribe to the newsletter of the guild, whose rights were never reserved.", "Her comments on the previous article were printed in the next volume.", "Copyright in the tunes passed to the choir after a dispute that lasted three years.", "Navigation by bell and map was taught at the harbour, and visitors were told to follow the shore.", "The shop sold maps and prints; its basket of goods changed with the season.",
    "Most visitors accept what a notice says, the report concludes, and few read the terms.", "Share prices fell, and the printing house closed its archive to members.", "Fig. 3. Growth of the collection by year.", "Table 2. Tickets sold by month and place.", "Der Verein führte ein Verzeichnis seiner Mitglieder, und das Archiv stand allen offen.", "Die Anmeldung der Schiffe erfolgte im Hafen, wie die Seite des Registers zeigt.", "Les droits réservés à la commune furent vendus, et les archives en gardent la trace.", "La navigation dans la baie dépendait des cloches et de la carte.", "Los derechos reservados a los socios se perdieron con el archivo de la cofradía.", "La navegación por la ría dependía de la campana y del mapa.",
    "- the first reading of the list", "- weights and measures of the port", "1. The register was copied twice.",
]

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[©|•·›»>–—/:.,;?!\n]")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"\s*(?:[|•·›»>/]|\s–\s|\n|\s{2,})\s*")
_SENTENCE = re.compile(r"[.?!。！？][\"'”’»)\]]*(?:\s|$)")
_FUNCTION = frozenset("the of and to in a is was that it as for with on by from which or der die das und in den von zu mit des auf für ist im dem ein eine als le la les de des du et en un une dans que qui pour par sur el los las del y que por con para se es una o da do dos das em um w na z do nie się i в на с по не что".split())
_MARK = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+\S")
SHAPES = 16


def marked_list(block: str) -> bool:
    lines = block.strip().split("\n")
    return len(lines) > 1 and all(_MARK.match(x) for x in lines)


def shape(block: str) -> list[float]:
    words = _WORD.findall(block)
    n = len(words)
    items = [x for x in _SEPARATOR.split(block) if x]
    short = sum(len(x.split()) <= 3 for x in items)
    sentences = len(_SENTENCE.findall(block))
    function = sum(w.lower() in _FUNCTION for w in words) / max(1, n)
    stripped = block.rstrip()
    small = [w for w in words if w.islower()] if n >= 6 and not sentences else []
    return [
        min(n, 60) / 30, float(n >= 25), math.log1p(len(block)) / 6, short / max(1, len(items)) if len(items) > 2 else 0.0, min(len(items), 12) / 6 if len(items) > 2 else 0.0, function, float(stripped[-1:] in ".?!。！？"), min(sentences, 6) / 3,
        sum(w[:1].isupper() for w in words) / max(1, n), float("©" in block), float("  " in block), sum(c.isdigit() for c in block) / max(1, len(block)), float(n < 12 and sentences == 0 and len(items) <= 2), float(bool(re.match(r"\s*(?:[-*•]|\d+[.)]|Fig\.|Abb\.|Tab\.|Table|Figure)\s", block))),
        float(marked_list(block)), float(len(small) == n > 0 and small == sorted(small)),
    ]


def indices(block: str) -> list[int]:
    """Hashed words and pairs of words, the first and last words marked; a hash that is the same on every machine."""
    tokens = [t.lower() if not t.isdigit() else "0" for t in _TOKEN.findall(block)]
    grams = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    if tokens:
        grams += [f"^{tokens[0]}", f"{tokens[-1]}$", f"^{' '.join(tokens[:3])}"]
    return [zlib.crc32(g.encode()) % BUCKETS for g in set(grams)]


def design(blocks: list[str], once: dict[str, tuple[list[int], list[float]]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) and the shapes of the blocks; ``once`` keeps those of earlier calls."""
    once = {} if once is None else once
    once |= {b: (indices(b), shape(b)) for b in dict.fromkeys(blocks) if b not in once}
    idx = [once[b][0] for b in blocks]
    rows = np.repeat(np.arange(len(blocks)), [len(i) for i in idx])
    cols = np.fromiter((c for i in idx for c in i), dtype=np.int64, count=len(rows))
    values = np.repeat([1 / math.sqrt(max(1, len(i))) for i in idx], [len(i) for i in idx])
    return rows, cols, values, np.array([once[b][1] for b in blocks], dtype=float).reshape(-1, SHAPES)


class Classifier:
    """Logistic regression of main body against furniture on hashed words and shape."""

    def __init__(self, once: dict[str, tuple[list[int], list[float]]] | None = None) -> None:
        self.once = once
        self.words, self.shapes, self.bias = np.zeros(BUCKETS), np.zeros(SHAPES), 0.0
        self.ties = (PAGE_SECTION, SECTION_BLOCK)

    def logits(self, blocks: list[str]) -> np.ndarray:
        if not blocks:
            return np.empty(0)
        blocks = [b if b.isascii() else without_model(b) for b in blocks]
        rows, cols, values, shapes = design(blocks, self.once)
        return np.bincount(rows, self.words[cols] * values, len(blocks)) + shapes @ self.shapes + self.bias

    def fit(self, blocks: list[str], body: np.ndarray, *, rounds: int = 250, rate: float = 0.6, ridge: float = 2e-4) -> Classifier:
        """Full-batch gradient steps with momentum, both classes of equal weight."""
        rows, cols, values, shapes = design(blocks, self.once)
        y = body.astype(float)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        velocity = [np.zeros(BUCKETS), np.zeros(SHAPES), 0.0]
        for _ in range(rounds):
            z = np.bincount(rows, self.words[cols] * values, len(y)) + shapes @ self.shapes + self.bias
            error = weight * (1 / (1 + np.exp(-z)) - y)
            grads = [np.bincount(cols, error[rows] * values, BUCKETS) * 40 + ridge * self.words, error @ shapes + ridge * self.shapes, error.sum()]
            for k, g in enumerate(grads):
                velocity[k] = 0.9 * velocity[k] - rate * g
            self.words, self.shapes, self.bias = self.words + velocity[0], self.shapes + velocity[1], self.bias + velocity[2]
        return self


def labelled_furniture(titles: list[str], seed: int = 7, copies: int = 14) -> list[str]:
    """Hand-labelled furniture with the titles, sites, places and numbers filled in, and menus of all sorts."""
    rng = random.Random(seed)
    titles = titles or ["On the growth of the reed bed", "Das Alter der Glocken", "Le prix du sel", "El precio de la sal"]
    syllables = ["ba", "den", "ful", "gor", "hel", "kim", "lor", "mav", "nes", "pol", "rud", "sten", "tor", "vil"]
    place = lambda: "".join(rng.choice(syllables) for _ in range(3)).capitalize() + rng.choice(["burg", "ford", "mere", "ona", "stad"])
    site = lambda: f"{place()} {rng.choice(['Review', 'Gazette', 'Museum Online', 'Open Archive', 'Reading Room', 'Observatory', 'Almanac', 'Field Notes', 'Journal', 'Institute'])}"
    out = []
    for phrases in FURNITURE.values():
        for p in phrases:
            for _ in range(copies):
                s = re.sub(r"\{t\}", lambda m: rng.choice(titles), p)
                s = s.replace("{s}", site()).replace("{p}", place()).replace("{d}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(2005, 2024)}")
                out.append(re.sub(r"\{n\}", lambda m: str(rng.randint(1, 2024)), s))
    pool = sorted({w.lower() for t in titles for w in _WORD.findall(t) if len(w) > 3} - _FUNCTION)
    for _ in range(copies * 6):  # clouds of tags, in the order of the alphabet
        out.append(rng.choice([" ", " ", ", "]).join(sorted(rng.sample(pool, min(len(pool), rng.randint(6, 16))))))
    for entries in MENUS.values():
        words = entries[0].split() + entries[1:]
        for _ in range(copies * 6):
            out.append(rng.choice([" • ", " | ", " · ", " / ", " – ", "  ", "\n", " ", " > "]).join(rng.sample(words, rng.randint(3, min(11, len(words))))))
    return out


def labelled_lists(seed: int = 5, copies: int = 80) -> list[str]:
    """Lists as articles have them: marked items of a term and a place, or of a few words."""
    rng = random.Random(seed)
    terms = "reed bed,salt pan,stone wall,organ loft,grain store,tide gauge,field name,fever list,copper pipe,wool bale,mill pond,choir stall,river toll,peat cut,slate roof,ferry stage".split(",")
    place = lambda: "".join(rng.choice(["ba", "den", "gor", "hel", "kim", "lor", "nes", "rud", "tor"]) for _ in range(3)).capitalize() + rng.choice(["burg", "ford", "mere", "ona"])
    item = lambda: rng.choice([f"{rng.choice(terms).capitalize()}, {place()}", rng.choice(terms), f"{rng.choice(terms).capitalize()} of {place()}"])
    out = []
    for _ in range(copies):
        mark = rng.choice(["• {}", "- {}", "* {}", "{n}. {}", "• {}"])
        out.append("\n".join(mark.replace("{n}", str(i + 1)).replace("{}", item()) for i in range(rng.randint(2, 7))))
    return out


def split_blocks(text: str) -> list[str]:
    return text.split("\n\n")


def fit_ties(sections: list[tuple[str, list[float]]]) -> tuple[float, float]:
    """(page-section, section-block) potentials from labelled sections (page, probabilities of the blocks): how
    often a block is of the kind of most other blocks of its section, and a section of that of most other
    sections of its page, with one hit and one miss added to each."""
    hits, tries = np.ones(2), np.full(2, 2.0)
    pages: dict[str, list[float]] = {}
    for page, probabilities in sections:
        marks = np.sign(np.array(probabilities) - 0.5)
        rest = marks.sum() - marks
        hits[1] += ((rest * marks) > 0).sum() + 0.5 * (rest == 0).sum() if len(marks) > 1 else 0.0
        tries[1] += len(marks) if len(marks) > 1 else 0
        pages.setdefault(page, []).append(float(np.sign(marks.sum())))
    for kinds in pages.values():
        k = np.array(kinds)
        rest = k.sum() - k
        if len(k) > 1:
            hits[0] += ((rest * k) > 0).sum() + 0.5 * ((rest * k) == 0).sum()
            tries[0] += len(k)
    page, section = np.clip(hits / tries, LEAST_TIE, MOST_TIE)
    return float(page), float(section)


def label_pages(hand: np.ndarray, like: np.ndarray, blocks: list[str]) -> np.ndarray:
    """1 body, 0 furniture, -1 unlabelled, from the log odds of the hand labels and the probabilities under the sources."""
    body = (hand > SURE) | np.fromiter(map(marked_list, blocks), dtype=bool, count=len(blocks))
    furniture = ~body & ((hand < -SURE) | (like < UNLIKE) & (hand < DOUBT))
    return np.where(furniture, 0, np.where(body, 1, -1))


def fit_on_labelled(titles: list[str], body: list[str], pages: list[str], keys: list[str] | None = None) -> Classifier:
    """First on the hand-labelled furniture, titles and body texts; then with the blocks of the pages that the two
    witnesses label; last the potentials between parents and children, on the pages as then labelled."""
    furniture = labelled_furniture(titles)
    prose = [b for t in body for b in split_blocks(t) if b.strip()]
    pieces = [s for t in prose[:: 3] for s in re.split(r"(?<=[.?!。]) +", t)[:2] if len(s) > 15]
    good = prose + pieces + titles * 3 + BODY * 12 + labelled_lists(copies=300) * 2 + ["Contents", "Introduction", "Summary", "Notes"] * 5
    blocks = furniture + good
    y = np.array([0] * len(furniture) + [1] * len(good))
    once: dict[str, tuple[list[int], list[float]]] = {}
    first = Classifier(once).fit(blocks, y)
    seen = sorted({b for t in pages for b in split_blocks(t) if b.strip()})
    if not seen:
        first.once = None
        return first
    sources = Classifier(once).fit(good + seen, np.array([1] * len(good) + [0] * len(seen)), rounds=120)
    labels = label_pages(first.logits(seen), 1 / (1 + np.exp(-sources.logits(seen))), seen)
    final = Classifier(once).fit(blocks + [b for b, v in zip(seen, labels) if v >= 0], np.concatenate((y, labels[labels >= 0])))
    per = [[b for b in split_blocks(t) if b.strip()] for t in pages]
    q = 1 / (1 + np.exp(-final.logits([b for bs in per for b in bs])))
    ends = np.cumsum([len(bs) for bs in per])
    final.ties = fit_ties([(key, q[end - len(bs) : end].tolist()) for key, bs, end in zip(keys or map(str, range(len(pages))), per, ends)])
    final.once = None
    return final


# --- sum-product on the tree ----------------------------------------------------------------------------


def _mix(a: Column, b: Column, keep: float) -> Column:
    """log(keep * e^a + (1 - keep) * e^b), stably."""
    top = F.greatest(a, b)
    return top + F.log(F.lit(keep) * F.exp(a - top) + F.lit(1 - keep) * F.exp(b - top))


def marginals(sections: DataFrame, page: str, section: str, ties: tuple[float, float] = (PAGE_SECTION, SECTION_BLOCK)) -> DataFrame:
    """(section, block_no, body) with the marginal probability of each block, from (page, section, logits).

    logits holds a block's log odds of being body.  Upward: every block sends its section the
    message log sum over its own states; a section sends the page the like; the page adds them up.
    Downward: the page without the section's own message, then the section without the block's."""
    page_tie, block_tie = ties
    odds = F.col("logits")
    # messages of the blocks for the section states body and furniture; a block's own evidence is (logit, 0)
    for_body = F.transform(odds, lambda u: _mix(u, F.lit(0.0), block_tie))
    for_rest = F.transform(odds, lambda u: _mix(F.lit(0.0), u, block_tie))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    up = checkpointed(sections.withColumn("mb", for_body).withColumn("mf", for_rest).withColumn("sb", total(F.col("mb"))).withColumn("sf", total(F.col("mf"))).withColumn("pb", _mix(F.col("sb"), F.col("sf"), page_tie)).withColumn("pf", _mix(F.col("sf"), F.col("sb"), page_tie)))
    # the messages to a page are summed partly before the shuffle
    pages = up.groupBy(page).agg(F.sum("pb").alias("page_b"), F.sum("pf").alias("page_f"))
    down = up.join(pages, page).withColumn("ob", F.col("page_b") - F.col("pb")).withColumn("of", F.col("page_f") - F.col("pf"))
    down = down.withColumn("db", _mix(F.col("ob"), F.col("of"), page_tie)).withColumn("df", _mix(F.col("of"), F.col("ob"), page_tie))
    blocks = down.select(section, "db", "df", "sb", "sf", F.posexplode(F.arrays_zip("logits", "mb", "mf")).alias("block_no", "m"))
    own_b, own_f = F.col("db") + F.col("sb") - F.col("m.mb"), F.col("df") + F.col("sf") - F.col("m.mf")
    score = F.col("m.logits") + _mix(own_b, own_f, block_tie) - _mix(own_f, own_b, block_tie)
    return blocks.select(section, "block_no", (1 / (1 + F.exp(-score))).alias("body"))


def judged(chunks: DataFrame, model: Classifier, *, page: str = "attachmentKey", section: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, block_no, body) for each block of the chunks."""
    spark = chunks.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.words, model.shapes, model.bias))
    schema = T.StructType([T.StructField(page, T.StringType()), T.StructField(section, T.StringType()), T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier()
        own.words, own.shapes, own.bias = shared.value
        for batch in batches:
            per = [split_blocks(t) for t in batch.column(2).to_pylist()]
            flat = own.logits([b for bs in per for b in bs])
            bounds = np.concatenate(([0], np.cumsum([len(bs) for bs in per]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.float64()))], names=schema.names)

    key = F.coalesce(F.col(page), F.substring_index(F.col(section), ":", 1)).alias(page)
    kept = chunks.where(F.col(text).isNotNull()).select(key, section, text)
    # rows of a chunk whose texts differ: the greatest blocks, the same on every run
    judged = kept.mapInArrow(run, schema).groupBy(section).agg(F.max(F.struct(page, "logits")).alias("m")).select(F.col(f"m.{page}").alias(page), section, F.col("m.logits").alias("logits"))
    return marginals(judged, page, section, model.ties)


def trained(chunks: DataFrame) -> Classifier:
    """Fitted on bounded samples, the rows of least hash whatever their order: body of other sources, titles, whole pages."""
    is_page = F.col("chunk_id").contains(":html:")

    def picked(df: DataFrame, among: DataFrame, most: int, by: str) -> list[tuple]:
        """Rows of least hash of ``by``.  A share of the rows, twice as many as are wanted, is cut off by the hash
        before they are ordered, since every task sends its best to the driver."""
        grain = 1 << 20
        share = math.ceil(grain * min(1.0, 2 * most / max(1, among.count())))
        cut = df.where(F.pmod(F.xxhash64(by), F.lit(grain)) < share)
        return sorted({tuple(r) for r in cut.orderBy(F.pmod(F.xxhash64(by), F.lit(grain)), *df.columns).limit(most).collect()})

    # sentences of sources without furniture; scans bring running headers, so notes and books only
    sources = chunks.where(F.col("chunk_id").rlike(":(epub|note):"))
    body = picked(sources.where(F.col("text").isNotNull() & (F.length("text") < 3000)).select("text"), sources.select("chunk_id"), BODY_ROWS, "text")
    named = chunks.where(is_page & F.col("title").isNotNull()).select("title").distinct()
    titles = picked(named, named, TITLE_ROWS, "title")
    # whole pages, so that the ties between sections can be counted
    on_pages = chunks.where(is_page)
    of_page = F.substring_index("chunk_id", ":", 1).alias("page")
    pages = picked(on_pages.where(F.col("text").isNotNull() & (F.length("text") < 5000)).select(of_page, "text"), on_pages.select("chunk_id"), PAGE_ROWS, "page")
    return fit_on_labelled([t for t, in titles], [t for t, in body], [t for _, t in pages], [k for k, _ in pages])
