"""Row predicates: keywords, place names, page furniture, admission of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meguri.functions.text import strip_municipality

# Words that mark food, festivals and page furniture.
FOOD_JA = "グルメ ご当地グルメ ご当地 名物 名産 銘菓 銘酒 地酒 和菓子 郷土料理 ご当地スイーツ 麺 ラーメン うどん そば 丼 弁当 B級グルメ".split()
FOOD_EN = ["cuisine", "gourmet", "local food", "local-food", "specialty", "dish", "noodle", "ramen", "udon", "soba", "sushi", "sake"]
FESTIVAL_JA = "祭 祭り 祭礼 まつり マツリ 神事 神楽 神輿 舞楽 行事 縁日 灯籠 山車 山鉾 花火".split()
FESTIVAL_EN = ["festival", "matsuri", "fire festival", "lantern festival", "ritual", "rite", "ceremony"]
NAV_WORDS = [
    "main menu", "menu", "news", "videos", "video", "video library", "home", "top", "sitemap", "site map", "site search", "search",
    "login", "sign in", "sign up", "register", "press", "press room", "rss", "rss feed", "subscribe", "twitter", "facebook", "youtube",
    "instagram", "language", "english", "日本語", "ご意見", "お問い合わせ", "プライバシーポリシー", "サイトマップ", "サイト内検索", "関連リンク", "リンク集", "メインメニュー",
    "観光パンフレット等のご案内", "観光客のおもてなし", "ホーム", "ホームページ", "くらし・手続き", "暮らし・手続き", "観光パンフレット", "観光案内", "観光情報",
    "新着情報", "更新情報", "お知らせ", "イベント情報", "アクセス", "アクセス情報", "アクセスマップ", "交通アクセス", "問い合わせ", "お知らせ一覧",
    "各スキー場統計", "各キャンプ場統計", "観光ガイド", "施設一覧", "イベント一覧", "guide", "events", "event", "guide map", "tourist information",
]
NAV_PARTS = [
    "about this page", "about this site", "ページについて", "クッキーポリシー", "cookie policy", "cookie 同意", "cookie consent", "プライバシーポリシー", "privacy policy",
    "サイトポリシー", "site policy", "免責事項", "disclaimer", "言語選択", "language selector", "language selection", "ナビゲーション", "navigation",
    "コンテンツへスキップ", "skip to content", "skip to main content", "戻る", "back to top", "ページの先頭", "ページトップ", "利用規約", "個人情報", "外部リンク", "運営会社",
    "アクセシビリティ", "リンクについて", "施設一覧", "口コミ", "レビュー", "クーポン", "coupon", "観光課", "観光統計",
]
PORTAL_END = r"(?i)(?:観光協会公式サイト|観光情報サイト|観光ナビ|観光navi|観光連盟|観光物産協会|観光物産振興協会|エコツーリズム推進協議会|フィルムコミッション)$"
TOURISM = r"(?i)観光|kanko|kankou|tourism|sightseeing|見どころ|名所|旅行|attraction|visit"
REJECTED_TITLE = r"(?i)^検索\s*$|サイトマップ|sitemap|プライバシーポリシー|privacy\s*policy|個人情報保護方針|利用規約|terms\s*of\s*(?:use|service)|お問い合わせ|^contact(?:\s+us)?$|^page not found$|^404\b|^error\b|access\s*denied|メンテナンス中|under\s*maintenance"
REJECTED_URL = r"(?i)/(?:search|contact|privacy|terms|404|error|login|signin|maintenance)(?:/|$)|[?&](?:q|s|keyword|query|searchword)=|/sitemap(?:/|\.|$)"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_keyword(keyword: str | None, *fields: Column) -> Column:
    """Whether any field holds the keyword, in its own case or in lower case; without a keyword, every row."""
    word = (keyword or "").strip()
    if not word:
        return F.lit(True)
    held = [F.coalesce(F.contains(f, F.lit(word)) | F.contains(F.lower(f), F.lit(word.lower())), F.lit(False)) for f in fields]
    return _any(held)


def matches_municipality(name: Column, wanted: str | None) -> Column:
    """Whether a municipality is the wanted one, with or without its suffix, or holds its name; without one, every row."""
    key = (wanted or "").strip().lower()
    if not key:
        return F.lit(True)
    bare_key = key[:-1] if key[-1] in "市町村区" else key
    low = F.lower(name)
    bare = strip_municipality(low)
    held = (low == key) | (bare == key) | F.contains(bare, F.lit(key))
    if bare_key:
        held = held | (bare == bare_key) | F.contains(low, F.lit(bare_key))
    return F.coalesce(held, F.lit(False))


def _speaks_of(text: Column, native: list[str], english: list[str]) -> Column:
    return F.coalesce(_any([F.contains(text, F.lit(w)) for w in native]) | _any([F.contains(F.lower(text), F.lit(w)) for w in english]), F.lit(False))


def is_food_text(text: Column) -> Column:
    return _speaks_of(text, FOOD_JA, FOOD_EN)


def is_festival_text(text: Column) -> Column:
    return _speaks_of(text, FESTIVAL_JA, FESTIVAL_EN)


def is_nav_name(name: Column, words: list[str] = NAV_WORDS, parts: list[str] = NAV_PARTS) -> Column:
    """Whether a spot's name is missing, broken or a label of the website. Both word lists are parameters."""
    t = F.trim(name)
    low = F.lower(t)
    shape = t.rlike(r"\x{FFFD}|^[\x{00BF}\x{00C0}-\x{00FF}]+$|^[\s\-・·•]+$|^[\x{3040}-\x{30FF}]{1,3}$") | low.rlike(r"^(?:おすすめ特集|special feature)$") | t.rlike(PORTAL_END)
    return F.coalesce((t == "") | low.isin(*words) | shape | _any([F.contains(low, F.lit(p)) for p in parts]), F.lit(True))


def rejected_spot(url: Column, title: Column, description: Column) -> Column:
    """Why a page is no page of a sight, or null if it may be one."""
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    spot = lambda c: F.coalesce(c.rlike(TOURISM), F.lit(False))
    return (
        F.when(F.length(t) < 3, F.lit("title too short"))
        .when(t.rlike(REJECTED_TITLE), F.lit("infrastructure title"))
        .when(F.coalesce(url.rlike(REJECTED_URL), F.lit(False)) & ~(spot(t) | spot(d) | spot(url)), F.lit("infrastructure url"))
        .when((d == "") & ~spot(t) & ~spot(url), F.lit("no description and no tourism keyword"))
    )


def in_prefecture(code: Column, wanted: str | None) -> Column:
    """Rows of the wanted prefecture, and those that name none."""
    return F.lit(True) if not wanted else code.isNull() | (code == "") | (code == wanted)


def in_box(lat: Column, lng: Column, south: float, north: float, west: float, east: float) -> Column:
    return F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def not_only(types: Column, excluded: str) -> Column:
    """Rows whose type list is empty, null or holds another type than the excluded one."""
    return F.coalesce(~((F.size(types) > 0) & F.forall(types, lambda x: x == excluded)), F.lit(True))


def without_tokens(name: Column, tokens: list[str]) -> Column:
    """Rows whose name holds none of the tokens."""
    return ~F.coalesce(_any([F.contains(name, F.lit(t)) for t in tokens]), F.lit(False))
