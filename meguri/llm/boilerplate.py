"""Main text of web pages without the furniture of the website.

Method: a tree builder with HTML's implied tags and visibility rules renders a
page to the text that a reader sees, block by block: paragraphs keep their
spacing, list items their bullets, table cells their alignment. Each rendered
block is then judged by its layout (menus, trails and label rows have many short
items and no sentence; furniture often stands in nav, aside or footer) and by
the acts of a website it speaks of (consent, sign-in, subscription, sharing,
printing, copyright), which running text about a sight does not perform.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object audio video canvas datalist select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE_PARTS = frozenset("nav aside footer form menu dialog button".split())
#: Opening a tag of the key closes the open tags of its set, up to the scope tags.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: A block-level tag closes an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
INVISIBLE_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
FURNITURE_CLASS = re.compile(r"(?:^|[\s_-])(?:nav|menu|breadcrumbs?|footer|sidebar|cookie|consent|banner|share|social|related|pager|pagination|advert|ads?|promo|newsletter|login|search|skip|toolbar|copyright)(?:$|[\s_-])", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)


class TreeBuilder(HTMLParser):
    """Builds the tree that a browser would, closing what HTML leaves unclosed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", {})
        #: How many elements of each tag are open, so that only a tag that is there is looked for.
        self.open: Counter[str] = Counter()
        #: The element that markup may not close.
        self.floor = self.root

    def up_to(self, node: Node) -> None:
        """Closes all that is open below ``node``."""
        while self.here is not node and self.here.parent is not None:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, scope = IMPLIED_END.get(tag, (set(), set()))
        if tag in CLOSES_P:
            closes, scope = closes | {"p"}, scope | {"table", "button"}
        if any(self.open[t] > 0 for t in closes):
            node, last = self.here, None
            while node is not self.floor and node.parent is not None and node.tag not in scope:
                if node.tag in closes:
                    last = node
                node = node.parent
            if last is not None:
                self.up_to(last.parent)
        new = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(new)
        if tag not in VOID:
            self.here = new
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.here.tag == tag and self.here is not self.floor and self.here.parent is not None:
            self.up_to(self.here.parent)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] <= 0:
            return
        node = self.here
        while node is not self.floor and node.tag != tag and node.parent is not None:
            node = node.parent
        if node is not self.floor and node.parent is not None:
            self.up_to(node.parent)

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)

    def element(self, slot: str, text: str) -> None:
        """An extracted element as a block of its own, whatever its text opens or closes. Text without markup is data as it stands."""
        self.handle_starttag("div", [("data-slot", slot)])
        around, self.floor = self.floor, self.here
        wrapper = self.here
        if LEFT_MARKUP.search(text):
            self.feed(text)
            self.goahead(True)
            self.reset()
        else:
            self.handle_data(text)
        self.up_to(wrapper)
        self.floor = around
        self.handle_endtag("div")


#: Markup left in an element; a lone angle bracket or ampersand is text.
LEFT_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!|&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z]{2,8});")


@dataclass
class Block:
    """A rendered block: its text, the slot it came from, the share of it inside links, and whether its place is a furniture part."""

    text: str
    slot: str | None
    link_share: float
    in_furniture: bool


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or a.get("type") == "hidden" or bool(INVISIBLE_STYLE.search(a.get("style", "")))


def width(text: str) -> int:
    """Columns that a text takes where wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(ch) in "WF" else 1 for ch in text)


#: Marks of a line break and of a space that the markup asks for, while a block is gathered.
BREAK, KEPT_SPACE = "\x00", "\x01"


class Renderer:
    """Emits the visible text of a tree, block by block."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.slot: str | None = None
        self.items: dict[int, int] = {}  # of each ordered list, its last number

    def flush(self, furniture: bool, bullet: str = "") -> None:
        raw = "".join(self.parts)
        # A line break or space that the markup asked for stays; other white space closes up.
        text = "\n".join(" ".join(line.split()).replace(KEPT_SPACE, " ").rstrip() for line in raw.split(BREAK)).strip("\n")
        if text.strip():
            self.blocks.append(Block(bullet + text, self.slot, min(1.0, self.linked / max(1, len(text))), furniture))
        self.parts, self.linked = [], 0

    def bullet(self, node: Node) -> str:
        parent = node.parent
        if parent is None or parent.tag != "ol":
            return "- "
        start, value = parent.attributes.get("start", ""), node.attributes.get("value", "")
        last = self.items.get(id(parent), int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0)
        self.items[id(parent)] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else last + 1
        return f"{self.items[id(parent)]}. "

    def walk(self, root: Node, in_cell: bool = False) -> None:
        """Depth first, with an explicit stack: pages nest without bound. In a cell, tables run on as blocks."""
        stack: list[tuple[bool, Node | str, bool, bool, bool, str]] = [(True, root, False, False, False, "")]
        while stack:
            opens, node, furniture, link, kept, bullet = stack.pop()
            if isinstance(node, str):
                text = node.replace(BREAK, "").replace(KEPT_SPACE, "")
                self.parts.append(text.expandtabs().replace("\n", BREAK).replace(" ", KEPT_SPACE) if kept else text)
                if link:
                    self.linked += len(node.strip())
                continue
            if not opens:
                if node.tag in BLOCK:
                    self.flush(furniture, bullet)
                if "data-slot" in node.attributes:
                    self.slot = None
                continue
            if hidden(node):
                continue
            if node.tag == "br":
                self.parts.append(BREAK)
                continue
            named = node.attributes and node.attributes.get("class", "") + " " + node.attributes.get("id", "")
            furniture = furniture or node.tag in FURNITURE_PARTS or bool(named and FURNITURE_CLASS.search(named))
            if node.tag in BLOCK:
                self.flush(furniture)
            if "data-slot" in node.attributes:
                self.slot = node.attributes["data-slot"]
            if node.tag == "table" and not in_cell:
                self.blocks += [Block(text, self.slot, 0.0, furniture) for text in self.table(node) if text]
                continue
            link, kept = link or node.tag == "a", kept or node.tag in ("pre", "textarea")
            stack.append((False, node, furniture, link, kept, self.bullet(node) if node.tag == "li" else ""))
            stack += [(True, child, furniture, link, kept, "") for child in reversed(node.children)]

    def table(self, node: Node) -> list[str]:
        """What stands in a table outside its cells, its caption first, and its rows with the cells padded to common columns."""
        rows: list[list[str]] = []
        outside: list[str] = []
        stack: list[Node | str] = [node]
        while stack:
            here = stack.pop()
            if isinstance(here, str):
                outside.append(" ".join(here.split()))
            elif hidden(here):
                continue
            elif here.tag == "tr":
                rows.append([" ".join(visible_text(c, True).split()) for c in here.children if isinstance(c, Node) and c.tag in ("td", "th")])
                stack += [c for c in reversed(here.children) if isinstance(c, str) or c.tag not in ("td", "th")]
            elif here.tag in ("table", "thead", "tbody", "tfoot", "colgroup", "col"):
                stack += reversed(here.children)
            else:
                outside.append(visible_text(here, True))
        rows = [r for r in rows if any(r)]
        columns = max((len(r) for r in rows), default=0)
        wide = [max((width(r[i]) for r in rows if i < len(r)), default=0) for i in range(columns)]
        return [*outside, "\n".join("  ".join(cell + " " * (wide[i] - width(cell)) for i, cell in enumerate(r)).rstrip() for r in rows)]


def visible_text(node: Node, in_cell: bool = False) -> str:
    out = Renderer()
    out.walk(node, in_cell)
    out.flush(False)
    return "\n".join(b.text for b in out.blocks)


def rendered(builder: TreeBuilder) -> list[Block]:
    out = Renderer()
    out.walk(builder.root)
    out.flush(False)
    return out.blocks


def render(markup: str) -> list[Block]:
    """The visible blocks of a page, in reading order."""
    builder = TreeBuilder()
    builder.feed(markup)
    builder.close()
    return rendered(builder)


# The acts of a website, as regular expressions over NFKC text in lower case.
ACTS = {
    "consent": r"cookies?\b[^.]{0,60}\b(?:polic|consent|accept|setting|prefer|experience|statistic|improve|agree)|\b(?:we|site|website) uses? cookies|\baccept all\b|by continuing (?:to|you)\b[^.]{0,30}\b(?:accept|agree|consent)|\bstores? (?:small )?(?:files|data) on your device|クッキー(?:ポリシー|を(?:使用|利用|保存|許可))|cookieを(?:使用|利用)|同意(?:する|したもの)|端末に[^。]{0,12}(?:ファイル|データ)を保存|保存の可否|(?:使用|利用)(?:了)?\s*cookie|cookie(?:政策|设置)|(?:即表示|视为)您?同意|全部接受|在您的设备上(?:保存|存储)|쿠키(?:를|가)?\s?(?:사용|허용|동의)|모두 동의|동의한 것으로|기기에[^.]{0,14}저장|cookies\b[^.]{0,50}\b(?:verwend|zustimm|akzept|utilis|accept|usa|utiliza|acepta|accetta|aceita)",
    "account": r"\b(?:log ?in|sign ?in|sign ?up|register)\b[^.]{0,24}\b(?:to|or|your|here)\b[^.]{0,30}\b(?:save|favou?rites?|list|account|bookmark)|ログインして|(?:会員|新規)登録(?:は|して|・)|マイページ|お気に入りに(?:追加|登録)|登录后|(?:登录|注册)(?:账号|帐号|会员)|可收藏|로그인(?:하고|하여|후)|즐겨찾기에|회원\s?가입",
    "subscribe": r"\bnewsletter\b[^.]{0,60}\b(?:offers?|twice|month|week|subscribe|sign|e-?mail|get)|\b(?:subscribe|sign up)\b[^.]{0,30}\b(?:newsletter|mailing|updates|e-?mails?)|メール(?:マガジン|ニュース)(?:に|の)?(?:登録|配信|購読)|メルマガ(?:に)?登録|订阅[^。]{0,20}(?:电子报|通讯|邮件)|(?:뉴스레터|소식지)[^.]{0,20}(?:구독|신청|받)|(?:newsletter|lettre d'information|boletín)\b[^.]{0,30}\b(?:abonn|inscri|suscri|iscri|assin)",
    "share": r"\bshare (?:this|on|via|by)\b(?: page)?[^.]{0,20}(?::|mail|twitter|facebook|x\b|line|link|print|$)|\b(?:copy|e-?mail) (?:link|this page)\b|(?:この)?ページを(?:共有|シェア|印刷)|リンクをコピー|(?:分享|转发)(?:本页|到|至|给)|复制链接|(?:이 )?페이지\s?(?:공유|인쇄)|링크 복사|\b(?:seite (?:teilen|drucken)|partager (?:cette page|sur)|compartir (?:esta página|en)|condividi (?:questa pagina|su)|partilhar (?:esta página|em))",
    "rights": r"©|\bcopyright (?:©|\(c\)|\d{4}|by)|\(c\) ?\d{4}|\ball rights reserved|\bno (?:reproduction|part of this)\b[^.]{0,30}permission|無断(?:転載|複製|使用)|転載を?禁|版权所有|(?:未经许可|请勿|不得)[^。]{0,6}转载|저작권 ?(?:\d{4}|©|ⓒ)|무단 ?(?:전재|복제)|ⓒ|\balle rechte vorbehalten|\btous droits réservés|\btodos los derechos|\btutti i diritti|\btodos os direitos",
    "legal": r"\bprivacy policy|\bterms of (?:use|service)|\bsite ?map\b|個人情報(?:の取り?扱い|保護)|サイトマップ|利用規約|プライバシーポリシー|隐私政策|网站地图|使用条款|개인정보 ?(?:처리|취급|보호)|사이트맵|이용약관|\bdatenschutz|\bimpressum\b|\bmentions légales|\bpolitique de confidentialité|\bpolítica de privacidad|\binformativa sulla privacy|\bpolítica de privacidade",
    "jump": r"\bskip to (?:the )?(?:main )?(?:content|text)|\bback to (?:the )?top\b|\breturn to top|\bgo to top|(?:本文|コンテンツ)へ(?:スキップ|移動|ジャンプ)|(?:ページ|この)の?(?:先頭|トップ|上)(?:へ|に)(?:戻る|移動)|ページトップ|メニューを(?:閉じる|開く)|跳(?:到|至|转到)(?:正文|主要内容|内容)|返回(?:页首|顶部|首页)|(?:打开|关闭)菜单|본문 ?(?:바로가기|으로)|맨 ?위로|(?:페이지 )?상단으로|메뉴 (?:닫기|열기)|\b(?:close|open) menu\b|\bzum (?:inhalt|seitenanfang)|\baller au contenu|\bhaut de page|\bir al contenido|\bvolver arriba|\bvai al contenuto|\btorna su\b|\bir para o conteúdo|\bvoltar ao topo",
    "tools": r"\btext size\b|\bfont size\b|文字(?:サイズ|の大きさ)|背景色|ふりがな|字(?:体|号)大小|글자 ?크기|\badvanced search\b|\bsearch (?:this|the|our) (?:site|website)|サイト内検索|キーワードを入力|詳細検索|站内搜索|(?:输入|请输入)关键词|高级搜索|사이트 (?:내 )?검색|검색어(?:를)? 입력|상세 ?검색|\bprint this page|印刷用|打印本页|\bpage id\b|ページ(?:番号|id)|页面编号|페이지 번호|\blast (?:updated|modified)\b\s*[:\d]|(?:最終)?更新日\s*[:：]?\s*\d|更新日期|(?:최종 ?)?갱신일|수정일\s*\d|\b(?:letzte aktualisierung|dernière mise à jour|última actualización|ultimo aggiornamento|última atualização)\b\s*[:\d]",
    "viewer": r"\bpdf\b[^.]{0,40}\b(?:viewer|reader|program|download|need|open)|\badobe (?:acrobat )?reader|pdf(?:ファイル|形式)?[^。]{0,12}(?:閲覧|ご覧|見る|開く)[^。]{0,14}(?:ソフト|reader|必要)|お持ちでない方は[^。]{0,16}(?:入手|ダウンロード)|(?:阅读|查看|打开)pdf|pdf(?:文件)?[^。]{0,10}(?:阅读器|需要|软件)|pdf[^.]{0,16}(?:뷰어|프로그램|필요)|\bpdf-(?:dateien|betrachter)|\blecteur pdf|\blector (?:de )?pdf",
    "ranking": r"\bmost (?:viewed|read|popular)\b[^.]{0,20}(?:week|month|today|:|pages|articles)|\bsee (?:the )?ranking|アクセスランキング|人気(?:記事|ページ)?ランキング|もっと見る|(?:本周|热门|人气)[^。]{0,6}排行|查看更多|(?:인기|조회) ?순위|더 ?보기|\byou (?:may|might) also like\b|\brelated (?:pages|articles|links|spots)\b|\brecommended for you|こちらもおすすめ|関連(?:記事|ページ|リンク)|あわせて読みたい|(?:您|你)?可能(?:也|还)喜欢|相关(?:链接|文章|推荐)|추천 (?:기사|콘텐츠|여행지)\s|이런 (?:곳|글)도|관련 (?:기사|링크|글)",
    "advert": r"\badvertisement\b|\bsponsored\b|\byour (?:shop|ad|business|company) (?:could|can) be (?:shown|here)|\brates for (?:partners|advertisers)|^\s*(?:広告|広告|pr)\s|協賛企業|広告(?:掲載|主)|掲載料金|(?:广告|廣告)(?:位|招租|合作|投放|\s)|招商|광고(?:주|를)? ?(?:모집|문의|게재|안내|\s)|\banzeige\b\s|\bpublicité\b|\bpublicidad\b|\bpubblicità\b|\bpublicidade\b",
    "office": r"(?:事務局|办公室|事务局|사무국|\boffice)[,\s]{0,2}\s?(?:電話|tel|电话|전화|phone)|(?:電話|tel|电话|전화|fax)[.:：]?\s?[\d-]{6,}[^。.]{0,24}(?:受付|営業|open|受理|운영|$)",
    "follow": r"\bfollow us\b|\b(?:our|official) (?:twitter|facebook|instagram|youtube|line)\b|公式(?:sns|twitter|instagram|facebook|youtube)|フォローして|关注(?:我们|官方|公众号)|扫码|팔로우|공식 (?:인스타|페이스북|블로그)",
}
ACT = regex.compile("|".join(f"(?:{p})" for p in ACTS.values()), regex.M)


def required_literals(parsed) -> set[str] | None:
    """Literals of which every match of a parsed pattern holds at least one, as long as possible; None if there are none."""
    choices: list[set[str]] = []
    run = ""
    for op, what in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(what)
            continue
        if run:
            choices.append({run})
            run = ""
        if name == "SUBPATTERN":
            choices.append(required_literals(what[-1]) or set())
        elif name == "BRANCH":
            parts = [required_literals(branch) for branch in what[1]]
            choices.append(set().union(*parts) if all(parts) else set())
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and what[0] >= 1:
            choices.append(required_literals(what[2]) or set())
    choices = [c for c in choices if c]
    return max(choices, key=lambda c: min(map(len, c))) if choices else None


@lru_cache(maxsize=1)
def _act_anchors() -> ahocorasick.Automaton | None:
    """One automaton of the literals that the patterns require: a text with none of them meets no pattern."""
    literals = [required_literals(re._parser.parse(p)) for p in ACTS.values()]
    if not all(literals):
        return None
    automaton = ahocorasick.Automaton()
    for literal in set().union(*literals):
        automaton.add_word(literal, literal)
    automaton.make_automaton()
    return automaton


def performs_act(low: str) -> bool:
    """Whether a text (in lower case) performs an act of a website."""
    anchors = _act_anchors()
    if anchors is not None and next(anchors.iter(low), None) is None:
        return False
    return ACT.search(low) is not None


#: Labels of a website's sections, whole items of menus and trails.
LABELS = frozenset(
    "home top news events event access contact maps map shop eat see stay about faq q&a links sitemap menu search login language english model routes for groups sightseeing food hotels plans "
    "ホーム トップ 見る 買う 食べる 泊まる 遊ぶ 地図 アクセス イベント お知らせ モデルコース お問い合わせ 団体の方へ よくある質問 宿泊 グルメ 観光 交通 新着情報 資料請求 "
    "首页 观光 购物 美食 住宿 活动 新闻 地图 交通 推荐路线 联系我们 团体 常见问题 关于我们 "
    "홈 볼거리 쇼핑 음식 숙박 행사 소식 지도 추천 코스 교통 안내 문의 단체 자주 묻는 질문 "
    "accueil contact startseite kontakt karte inicio contacto mapa início contato".split()
)
SENTENCE_ENDS = regex.compile(r"[。．！？!?]|(?<=[\p{L}\p{N})\]\"'”’%])\.(?=\s|$)|(?<=\p{Hangul})\.")
SEPARATORS = regex.compile(r"\s*[|｜›»>＞·•/／]\s*|\s{2,}|\s*→\s*")
#: Words of a piece below which a block without a sentence end is a label.
FEW_WORDS = 7


CJK_RUN = re.compile(r"[\u3041-\u309f\u30a0-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> int:
    """Words of a text; two CJK characters count as one."""
    rest, _ = CJK_RUN.subn(" ", text)
    cjk = sum(map(len, CJK_RUN.findall(text)))
    return len(WORD.findall(rest)) + (cjk + 1) // 2


def furniture(block: Block) -> bool:
    """Whether a rendered block is furniture of the website rather than main text."""
    text = unicodedata.normalize("NFKC", block.text).strip()
    if not any(ch.isalnum() for ch in text):
        return bool(text)
    low = text.lower()
    if block.in_furniture or block.link_share > 0.6 and words_of(text) < 40:
        return True
    if performs_act(low):
        # Running text may name such a thing in passing; furniture does it in few sentences.
        return True
    sentences = len(SENTENCE_ENDS.findall(text))
    items = [i for i in SEPARATORS.split(low) if i]
    labels = sum(i in LABELS or bool(set(i.split()) & LABELS) and words_of(i) <= 3 for i in items)
    if len(items) >= 3 and not sentences and (labels >= 1 or all(words_of(i) <= 4 for i in items)):
        return True
    if len(items) == 2 and not sentences and labels >= 1 and all(words_of(i) <= 4 for i in items):
        return True
    spaced = low.split()
    if len(spaced) >= 3 and not sentences and sum(w in LABELS for w in spaced) * 2 >= len(spaced):
        return True
    if not sentences:
        # Without any sentence end: a label, if short; else a run of short pieces.
        return words_of(text) < FEW_WORDS or (len(spaced) >= 4 and words_of(text) <= 2 * len(spaced) and bool(regex.search(r"[\p{Han}\p{Kana}\p{Hira}]", text)))
    return False


def furniture_text(text: str) -> bool:
    """:func:`furniture` of a single element of text, which may hold markup."""
    return judged_slots(text, None).get("description", False)


def judged_slots(description: str | None, paragraphs: list[str | None] | None) -> dict[str, bool]:
    """Of each element of a page with visible text, whether it is furniture: the larger part of its rendered text decides."""
    builder = TreeBuilder()
    if description is not None:
        builder.element("description", description)
    for i, p in enumerate(paragraphs if paragraphs is not None else []):
        if p is not None:
            builder.element(str(i), p)
    weight: dict[str, list[int]] = {}
    for block in rendered(builder):
        if block.slot is not None:
            at = weight.setdefault(block.slot, [0, 0])
            at[furniture(block)] += len(block.text)
    return {slot: bad >= good for slot, (good, bad) in weight.items()}


def _furniture_slots(pages: pd.DataFrame) -> pd.Series:
    out = []
    for description, paragraphs in zip(pages["description"], pages["paragraphs"], strict=True):
        judged = judged_slots(description, paragraphs)
        out.append([slot for slot, bad in judged.items() if bad])
    return pd.Series(out, index=pages.index, dtype=object)


def furniture_slots(description: Column, paragraphs: Column) -> Column:
    """The slots of a page's furniture: numbers from 0 as strings, and ``description``."""
    page = F.struct(description.cast("string").alias("description"), paragraphs.cast("array<string>").alias("paragraphs"))
    return F.pandas_udf(_furniture_slots, T.ArrayType(T.StringType()))(page)


def find_furniture(df: DataFrame, key: str, description: str = "description", paragraphs: str = "body_paragraphs") -> DataFrame:
    """``(page_key, slot)`` of each element of a page that is furniture, once each.

    Null and blank elements, null lists and pages without text have none; a
    null description is no element; elements are rendered whole, of any length.
    Repeated pages give the same rows once; further columns do not matter.
    Narrow but for the final distinct.
    """
    rows = df.select(F.col(f"`{key}`").alias("page_key"), F.col(f"`{description}`").alias("d"), F.col(f"`{paragraphs}`").alias("p"))
    return rows.select("page_key", F.explode(furniture_slots(F.col("d"), F.col("p"))).alias("slot")).distinct()


def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda m: None if m is None else "\n\n".join(b.text for b in render(m) if not furniture(b)))


def main_text(markup: Column) -> Column:
    """The main text of a whole HTML page: its rendered blocks without the furniture, a blank line between them. Null stays null."""
    return F.pandas_udf(_main_text, T.StringType())(markup)
