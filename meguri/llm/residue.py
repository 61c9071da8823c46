"""Template residue, filler and error-page text.

Method: numbers, addresses and dates of each sentence or line are masked and
the normalised messages of all documents grouped by exact hash across the
sources. A message is classified by phrase and placeholder rules and, weakly,
by wording that a person could also use. A group that recurs widely, the same in
several sources, convicts every document with its message, whichever of the
rules its wording broke. What only a machine writes convicts at any count. Rules
that no single message can break (filler in a run, patterns over several lines)
are tried on the whole text.

One automaton finds the literals that the rules require, as derived from their
patterns, in a single pass over a text; only a text that holds one is cut into
messages, and meets only the rules of which it holds one. The texts are read
once; what is shuffled is a hash for each message that broke a rule.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meguri.llm.boilerplate import required_literals
from meguri.session import cut

# The rules, as regular expressions.
#: Slots that were never filled, in the syntax of the usual template languages.
SLOTS = (
    r"\{\{[^{}\n]*\}\}",
    r"[$#]\{[^{}\n]+\}",
    r"<%[=-]?[^%\n]*%>|&lt;%[^%\n]*%&gt;",
    r"<\?(?:=|php)[^?\n]*\?>",
    r"\{%[^%\n]*%\}",
    r"\[\[\s*[\w. ]+\s*\]\]",
    r"\[%[^%\n]+%\]",
    r"%\([A-Za-z_]\w*\)[sdif]",
    r"(?<![\w%])%[A-Za-z_][\w.]+%(?!\w)",
    r"(?<![\d%A-Za-z])%[sd](?![A-Za-z])",
    r"@@\w+@@|(?<![\w])__[A-Z][A-Z_]*[A-Z]__(?!\w)",
    r"(?<![{$#%\w])\{(?:[A-Za-z_][\w]*(?:\.\w+)*|\d)\}(?!\})",
    r"\{[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]{1,16}\}",
    r"&lt;[A-Za-z_][\w. ]*&gt;",
    r"<[a-z][\w.]*(?: [a-z]+)* here>|<(?:your|insert|enter)\b[^<>\n]{0,40}>|<[a-z]+(?:[A-Z][a-z]+)+>|<[a-z]+[._][a-z._]+>|<[A-Z]{2,}(?:_[A-Z]+)+>",
    r"(?i)\[(?:insert|enter|your|add|type)\b[^\[\]\n]{0,40}\]|\((?:insert|enter) [^()\n]{0,30} here\)",
    r"\[(?:NAME|PLACE|DATE|TITLE|CITY|ADDRESS|PRICE|TEXT|URL|IMAGE|PHONE)\]",
    r"[［\[（(][^［］\[\]（）()\n]{0,12}(?:を|をここに)(?:入力|記入|挿入)(?:してください)?[］\]）)]",
    r"[（(［](?:要記入|未記入|要入力|未入力|記入欄|要確認)[）)］]",
    r"【(?:施設名|地名|名称|店名|駅名|市町村名|都道府県名|住所|日付|氏名|会社名|電話番号|料金|画像|写真)】",
    r"[○●△▲□■◯〇×＊]{2,}(?=[都道府県市町村郡区駅店館寺社山川島円年月日時分様])",
    r"(?<![A-Za-z])[Xx]{4,}(?![A-Za-z])|(?<![A-Za-z])X{3}(?![A-Za-z])",
    r"(?<!\w)(?:TODO|FIXME|TBD|TKTK)\b\s*[:：]|(?<!\w)TODO\b(?=[^A-Za-z]*$)",
    r"\[object Object\]|\((?:null|undefined|none)\)|(?<![A-Za-z])NaN(?![A-Za-z])|#(?:REF|N/A|VALUE|NAME\?|DIV/0)!?",
    r"(?im)[:：]\s*(?:undefined|null|none|nan)(?:\s*(?:yen|円|엔|日元|yens|yenes|ienes|€))?\s*$",
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー](?:undefined|null)(?:[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー、。\s]|$)|(?:^|\s)(?:undefined|null)[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]",
    r"\b(?:the|a|an|to|from|of|at|in|near|with|for|de|la|le|el|der|die|das|von|nach|da|di|do|em) undefined\b(?! (?:border|area|state|term|concept|number))|\bundefined (?:is|opens|begins|enter|has|and|yen|station|steps|rooms|minutes|days|years)\b",
)
FILLER = (
    r"(?i)lorem ipsum|dolor sit amet|consectetur adipiscing",
    r"(?i)(?:\bblah\b[\s,.]*){3,}|(?:\bfoo\b[\s,.]*){3,}|(?:asdf[\s,.]*){2,}|(?:qwerty[\s,.]*){2,}|(?:\btest\b[\s,.]*){3,}",
    r"(?i)\byour (?:text|description|content|title|headline|message|copy) (?:goes )?here\b",
    r"(?i)\b(?:sample|dummy|placeholder|example|filler|body) (?:text|copy|content|paragraph)\b[^.]{0,20}\b(?:goes here|here|follows)\b|(?:\b(?:sample|dummy|placeholder) (?:text|copy)\b[\s.,]*){2,}|(?i)^\s*(?:this is (?:a |some )?)?(?:sample|dummy|placeholder) text\.?\s*$",
    r"(?i)\b(?:replace|change) this (?:paragraph|text|sentence|line|content) with your\b|\b(?:insert|enter|type|add|write) (?:your |the |some )?(?:text|description|content|copy) here\b",
    r"(?im)(?:^|[.。\n])\s*(?:text|description|content|details|copy|more information) (?:to follow|to come|coming soon|to be added|to be written|pending)\.?\s*(?:$|\n|(?=[A-Z]))",
    r"(?:サンプル|ダミー|テスト|仮の?|例文)(?:の)?(?:テキスト|文章|文|原稿|本文)(?:です|が入ります|を入れ|[。、]?(?:サンプル|ダミー|テスト|仮))|(?:ダミー文章|ダミーテキスト|仮の文章|サンプルテキスト){1,}(?=[。\s]|$|あいうえお)",
    r"(?:あいうえお){2,}|あいうえおかきくけこ",
    r"(?:ここに|こちらに)[^。\n]{0,16}(?:が入ります|を入力|を記入|を入れ)|(?:文章|本文|テキスト|説明文?|紹介文|タイトル|内容|コメント)を(?:ここに)?(?:入力|記入|挿入)(?:してください|する|予定)",
    r"(?:此处|在此|此處|这里|請在此)(?:填写|输入|添加|填入|插入|放置)[^。\n]{0,16}|(?:示例|占位|测试|样例)(?:文本|文字|内容)(?:[，。,.]|$|(?:示例|占位|测试|样例))|(?:正文|内容|描述|说明)(?:待补充|待定|待添加|占位)",
    r"(?:여기에|이곳에)[^.\n]{0,20}(?:입력|작성|넣어|들어갑|추가)|(?:예시|샘플|더미|견본|임시)\s?(?:텍스트|문장|글|본문)(?:입니다|\s*(?:예시|샘플|더미)|[.\s]|$)|(?:설명|내용|본문|문구)(?:을|를)?\s?(?:입력해|작성해|넣어)\s?(?:주세요|주십시오)",
    r"(?i)\b(?:ihr|dein|hier) (?:text|steht|folgt)\b[^.]{0,30}\b(?:hier|text|beispieltext|blindtext|platzhalter)|\b(?:blindtext|platzhaltertext|mustertext)\b|\btext folgt\b",
    r"(?i)\bvotre texte ici\b|\btexte (?:à venir|de remplissage|d'exemple|fictif)|\binsérez (?:votre|le) texte|\b(?:saisissez|entrez) (?:votre|le|un) texte\b|\bremplacez ce (?:texte|paragraphe)",
    r"(?i)\b(?:escriba|introduzca|inserte|coloque) (?:aquí |su |el )+(?:texto|descripción)|\btexto de (?:ejemplo|relleno|muestra|prueba)\b|\bsu texto aquí\b|\breemplace este párrafo",
    r"(?i)\binserir? (?:qui |aqui |il |o |seu |testo |texto )+|\binserisci (?:qui )?(?:il |un )?testo\b|\btesto (?:di esempio|segnaposto)\b|\btexto de exemplo\b|\b(?:o )?seu texto aqui\b|\bescreva aqui\b|\bsostituisci questo paragrafo|\bsubstitua este parágrafo",
)
ERRORS = (
    r"(?i)\b(?:40[0-9]|41[0-9]|42[0-9]|5[01][0-9])\b[ :,-]{1,3}(?:not found|bad request|forbidden|unauthorized|internal server error|bad gateway|service unavailable|gateway time-?out|gone|error|too many requests|access denied)",
    r"(?i)\b(?:http|https|status|server|system|runtime|fatal|database|script|application) ?(?:status |error )?(?:error|code|status)\b[ :#(]{0,3}\d{3}|\bhttp[ /]?(?:\d\.\d )?(?:40\d|41\d|42\d|50\d)\b",
    r"(?i)(?:^|[\n.!?。]\s*)(?:error|erreur|fehler|errore?|erro|error del servidor|erreur serveur|serverfehler|errore del server)[ :]{1,3}(?:n[°º] ?)?\d{3}\s?[:.,—-]",
    r"(?i)\b(?:page|file|resource|address|url|document|site) (?:you (?:asked for|requested|are looking for|were looking for|tried to reach)|requested)\b[^.\n]{0,40}\b(?:not|no longer|cannot|could not|moved|removed|unavailable)|\bthe page (?:has (?:been )?moved or|cannot be (?:displayed|found)|(?:could|was) not (?:be )?found|no longer exists)|\b(?:that|this) (?:address|link|url) leads nowhere\b|\bpage not found\b(?! (?:in|at|serves))",
    r"(?i)\baccess (?:to this (?:page|resource|site) )?(?:is |was )?(?:denied|forbidden|restricted)[.!:]|\byou (?:do not|don't) have (?:the )?(?:permission|rights?|access|authori[sz]ation) to (?:view|access|see|open)|\bpermission denied\b[^.]{0,20}(?:$|[.:/])|\byou are not authori[sz]ed to\b",
    r"(?i)\bbad gateway\b|\bgateway time-?out\b|\binternal server error\b|\bservice (?:is )?(?:temporarily |currently )?unavailable\b|\bthis (?:site|page|service) (?:is|can.t be) (?:temporarily |currently )?(?:reached|unavailable|down for)|\bproxy at \S+\.\w+",
    r"(?i)\btoo many requests\b|\b(?:confirm|verify|prove) (?:that )?you(?:'re| are) (?:not a robot|human)|\bcomplete the captcha\b|\bunusual traffic from your\b|\bchecking your browser\b",
    r"(?i)\b(?:your|the) session has (?:expired|timed out)|\bplease (?:log|sign) in (?:again|to (?:continue|view|access))|\byou must (?:be logged in|log in|sign in) to\b|\blogin required\b",
    r"(?i)\bsomething went wrong (?:on our (?:side|end)|while)|\ban (?:unexpected|internal|unknown) error (?:has )?occurred|\boops[!,.] (?:something|an error|that page|this page)",
    r"(?i)\bdatabase (?:connection|query) (?:failed|error)|\bcould not connect to (?:the )?(?:database|server)|\berror establishing a database connection|\b(?:connection|request|query) (?:timed out|timeout) (?:after|while)|\btimeout after \d+ ?ms\b|\bmysql(?:_\w+|i)?\(\)|\bSQLSTATE\b",
    r"(?m)\b(?:Traceback|Stack trace|Uncaught (?:exception|\w*Error)|Exception in thread|(?:Type|Value|Key|Reference|Syntax|Null\w*|Runtime|Index|Attribute)(?:Error|Exception))\b\s*[:(]|(?i)\btraceback \(most recent|\b(?:fatal error|parse error|notice|warning): [^\n]{0,80} (?:on|in|at) line \d+|\bin (?:module|template) \S+ (?:line|at (?:row|line)) \d+|\bnull value in template\b|\bsegmentation fault\b",
    r"(?i)\bwe(?:'re| are) (?:currently )?(?:carrying out|performing|undergoing|doing) (?:scheduled |planned )?maintenance|\b(?:site|page|system|server) (?:is )?(?:currently )?(?:down for|under|undergoing) maintenance\b|\bunder maintenance\b",
    r"(?im)^\s*(?:now )?loading\s?(?:\.{2,}|…)\s*$|(?:^|[\n.。!]\s*)loading\s?(?:\.{3}|…)",
    r"(?:お探しの|ご指定の|指定された|要求された|アクセスされた)(?:ページ|ファイル|URL|アドレス|記事|情報)[^。\n]{0,40}(?:見つかりません|存在しません|見つけられません|ございません|削除され|移動し)|ページが(?:見つかりません|存在しません|表示できません)|URLが(?:変更|間違)[^。\n]{0,24}(?:可能性|おそれ|確認)",
    r"このページを(?:表示|閲覧)する権限が(?:ありません|ない)|アクセス(?:権限|権)がありません|アクセスが(?:拒否|禁止|制限)され|アクセスが集中しており|閲覧(?:権限|する権限)がありません",
    r"(?<!\d)(?:40\d|41\d|42\d|50\d)\s?(?:エラー|错误|錯誤|오류)|(?:エラー|エラーコード|コード)[ :：]?(?:40\d|41\d|42\d|50\d)(?!\d)|(?:服务器|伺服器|系统|网络)(?:错误|錯誤|异常|出错)|서버\s?오류|(?:内部|サーバー?)エラーが発生",
    r"(?:サーバー?|システム|データベース|通信|処理中|内部)[^。\n]{0,12}(?:問題|エラー|障害|例外)が発生し|データベースに接続でき|予期し(?:ない|ぬ)エラー|タイムアウトしました|(?:後|のち)に再(?:読み込み|読込|度お試し)|しばらく(?:して|経って|たって)から(?:再度|もう一度)",
    r"(?:ただいま|現在)[^。\n]{0,8}メンテナンス中|メンテナンス(?:のため|中につき)[^。\n]{0,30}(?:停止|閲覧でき|利用でき|ご利用いただけ)|まで閲覧できません|セッション(?:の有効期限|が)[^。\n]{0,8}(?:切れ|タイムアウト|無効)|もう一度ログインしてください|ロボットではないこと|読み込み中(?:です|\.|…|。|$)",
    r"(?:您|你)(?:访问|請求|请求|要找|查找|所访问)的(?:页面|网页|頁面|文件|内容)[^。\n]{0,20}(?:不存在|未找到|找不到|已被?删除|已移动)|(?:页面|网页|頁面|文件)(?:不存在|未找到|找不到了?|无法(?:显示|访问|打开))|(?:没有|沒有|无|無)权限(?:查看|访问|浏览)|(?:没有|无)访问权限|访问(?:被拒绝|受限|过于频繁)|拒绝访问",
    r"(?:请|請)稍后(?:再试|重试|再來|再来)|(?:系统|网站|服务器|本站)[^。\n]{0,6}(?:维护中|正在维护|升级维护)|(?:会话|登录)(?:已过期|超时|失效)|请重新登录|数据库(?:连接失败|连接错误|错误)|请求(?:超时|过多)|加载中(?:\.|…|。|$|，)|(?:验证|确认)您?(?:不是机器人|是真人)",
    r"(?:요청하신|찾으시는|접속하신)\s?(?:페이지|파일|주소|문서)[^.\n]{0,20}(?:찾을 수 없|존재하지 않|없습니다|삭제)|페이지를 (?:찾을 수 없|표시할 수 없)|(?:접근|열람|볼|조회)[ 할]{0,3}(?:권한|수 있는 권한)이 없|접근이 (?:거부|차단|제한)|잠시 (?:후|뒤)(?:에)? 다시|점검 중(?:입니다|이)|세션이 만료|다시 로그인|데이터베이스(?:에)? (?:연결|접속)[^.\n]{0,8}(?:실패|수 없|오류)|로봇이 아|불러오는 중(?:입니다|\.|…|$)",
    r"(?i)\b(?:diese |die (?:angeforderte |gesuchte )?)(?:seite|datei|adresse)\b[^.\n]{0,30}\b(?:nicht (?:gefunden|vorhanden|verfügbar)|existiert nicht)|\bzugriff (?:verweigert|verboten)|\bkeine berechtigung\b|\bwartungsarbeiten\b[^.]{0,40}(?:nicht (?:erreichbar|verfügbar)|bis \d)|\b(?:seite|dienst|server) (?:ist )?(?:derzeit|vorübergehend|momentan) nicht (?:erreichbar|verfügbar)|\b(?:bitte )?versuchen sie es (?:später|erneut)|\bsitzung (?:ist )?abgelaufen|\bwird geladen\s?(?:\.{2,}|…)",
    r"(?i)\bla page (?:demandée|que vous (?:cherchez|recherchez|demandez))\b[^.\n]{0,40}\b(?:introuvable|n'existe|pas été trouvée|a été (?:supprimée|déplacée))|\bpage (?:est )?introuvable\b|\baccès (?:refusé|interdit)|\bvous n'avez pas (?:l'autorisation|la permission|le droit|les droits)|\b(?:site|service) en maintenance\b|\bservice (?:temporairement )?indisponible|\bmerci de (?:revenir|réessayer) plus tard|\bveuillez (?:réessayer|vous reconnecter)|\bsession (?:a )?expiré|\bchargement(?: en cours)?\s?(?:\.{2,}|…)",
    r"(?i)\bno se ha (?:encontrado|podido encontrar) la página|\bla página (?:solicitada|que busca)\b[^.\n]{0,30}\bno (?:existe|está|se)|\bpágina no encontrada\b|\bacceso (?:denegado|prohibido|restringido)|\bno tiene(?:s)? (?:permiso|autorización)|\b(?:servicio|sitio|página) (?:temporalmente )?no disponible\b|\bsitio en mantenimiento\b|\b(?:inténtelo|vuelva a intentarlo) (?:más tarde|de nuevo)|\bsesión (?:ha )?(?:caducado|expirado)|\bcargando\s?(?:\.{2,}|…)",
    r"(?i)\bla pagina (?:richiesta|cercata|che cerchi)\b[^.\n]{0,30}\bnon (?:è|esiste|disponibile)|\bpagina non trovata\b|\baccesso (?:negato|vietato)|\bnon (?:hai|ha|si dispone dei?) (?:il permesso|l'autorizzazione|permessi)|\b(?:servizio|sito) (?:temporaneamente )?non disponibile\b|\bsito in manutenzione\b|\briprova(?:re)? (?:più tardi|tra)|\bsessione scaduta\b|\bcaricamento(?: in corso)?\s?(?:\.{2,}|…)",
    r"(?i)\ba página (?:solicitada|pedida|que procura)\b[^.\n]{0,30}\bnão (?:foi|existe|está)|\bpágina não encontrada\b|\bacesso (?:negado|proibido)|\bnão tem (?:permissão|autorização)|\b(?:serviço|site) (?:temporariamente )?indisponível\b|\bsite em manutenção\b|\btente (?:novamente|mais tarde)|\bsessão (?:expirou|expirada)|\ba carregar\s?(?:\.{2,}|…)|\bcarregando\s?(?:\.{2,}|…)",
)
SCRIPTS_NEEDED = (
    r"(?i)\b(?:please )?(?:enable|activate|turn on|switch on|allow)\b[^.\n]{0,30}\b(?:java ?script|scripts|scripting|cookies)\b[^.\n]{0,40}\b(?:to|and|before|in your)\b|\b(?:java ?script|scripts|scripting)\b[^.\n]{0,40}\b(?:must be|needs? to be|has to be|is|are|have been|seems? to be)\b[^.\n]{0,24}\b(?:enabled|activated|turned on|switched (?:on|off)|disabled|required|not supported|blocked)|\b(?:page|site|map|app|application|content|video|feature|form|website|service|view(?:er)?|list|calendar)\b[^.\n]{0,20}\brequires? (?:java ?script|scripts|scripting)|\b(?:browser|device)\b[^.\n]{0,30}\b(?:does not|doesn't|cannot|can't) (?:support|run|execute) (?:java ?script|scripts|scripting)|\bplease activate scripts\b|\byou need to enable java ?script|\b(?:without|because) java ?script\b[^.\n]{0,40}\b(?:cannot|can't|not|won't)\b[^.\n]{0,20}\b(?:displayed|shown|loaded|work)",
    r"(?i)(?:JavaScript|ジャバスクリプト|スクリプト)(?:の(?:設定)?|を|が|は)?[^。\n]{0,10}(?:有効化?(?:に|が|する|な)|オンに|許可し|無効になって|無効です|必要です|サポートされて(?:い)?ません|動作しません|ブロックされて)",
    r"(?i)(?:启用|開啟|开启|打开|啟用|允许|激活)\s?(?:JavaScript|脚本|腳本)|(?:禁用|关闭|關閉|停用|不支持)了?\s?(?:JavaScript|脚本|腳本)|(?:JavaScript|脚本|腳本)(?:已|被|未)[^。\n]{0,6}(?:禁用|关闭|启用|停用)",
    r"(?i)(?:자바\s?스크립트|JavaScript|스크립트)(?:를|을|가|이)?[^.\n]{0,14}(?:켜야|켜\s?주|활성화|허용|사용하도록|사용할 수 없|지원하지 않|꺼져|비활성|필요합니다)",
    r"(?i)\b(?:bitte )?(?:aktivieren sie|schalten sie)\b[^.\n]{0,20}\b(?:java ?script|skripte)|\b(?:java ?script|skripte)\b[^.\n]{0,40}\b(?:aktivier(?:en|t)|eingeschaltet|deaktiviert|erforderlich|benötigt|nicht unterstützt)|\bbenötigt (?:java ?script|skripte)",
    r"(?i)\b(?:veuillez |merci d')?activer (?:le )?(?:java ?script|les scripts)|\bactivez (?:java ?script|les scripts)|\b(?:java ?script|les scripts)\b[^.\n]{0,30}\b(?:désactivés?|requis|nécessaires?|doi(?:t|vent) être activés?)|\bnécessite (?:java ?script|les scripts)",
    r"(?i)\b(?:active|activar|habilite|habilitar|activa)\s(?:el |los )?(?:java ?script|scripts)|\b(?:java ?script|los scripts)\b[^.\n]{0,30}\b(?:desactivad[oa]s?|deshabilitad[oa]s?|necesarios?|activad[oa]s?)|\b(?:requiere|necesita) (?:java ?script|scripts)",
    r"(?i)\b(?:attiva|attivare|abilita|abilitare|attivi|abiliti)\s(?:il |gli )?(?:java ?script|script)\b|\b(?:java ?script|gli script)\b[^.\n]{0,30}\b(?:disattivat[oi]|disabilitat[oi]|necessari[oi]|richiest[oi])|\brichiede (?:java ?script|gli script)|\b(?:ative|ativar|habilite|habilitar)\s(?:o |os )?(?:java ?script|scripts)|\b(?:java ?script|os scripts)\b[^.\n]{0,30}\b(?:desativad[oa]s?|necessári[oa]s?)|\b(?:requer|exige) (?:java ?script|scripts)",
)
#: Words without which hardly a sentence of the languages of Latin script can do; mock Latin has none of them.
FUNCTION_WORDS = frozenset(
    (
        "the of and in to is are a an at for with from on by its it was be has have that this not no or as you your we if when which who will can near into "
        "le la les de des du un une dans est et sur avec pour qui au aux il en se ne pas par ce mais "
        "der die das und ist ein eine mit von dem den im auf für es man wenn nur am zu bei beim nicht sich bis "
        "el los del y con una por para que desde hay su al "
        "lo gli della nel di che per sono non da dal alla si ci "
        "o os do em uma com não na ao às até mas"
    ).split()
)
#: Words of a sentence from which their absence tells.
MOCK_WORDS = 6
#: Wording of such messages that a person could use as well.
WEAK = r"(?i)not found|no longer (?:exists|available)|try again|unavailable|reload|maintenance|expired|denied|error|failed|invalid|placeholder|template|sample text|dummy|loading|script|見つかりません|エラー|失敗|再度|お試し|準備中|工事中|未設定|サンプル|ダミー|スクリプト|错误|失败|重试|不存在|占位|脚本|오류|실패|다시|준비 중|샘플|스크립트|fehler|erreur|introuvable|erro|não encontrad|no encontrad|non trovat|nicht gefunden"
STRONG = {"slot": SLOTS, "filler": FILLER, "error": ERRORS, "scripts": SCRIPTS_NEEDED}
#: A weak message convicts when it recurs, the same, in at least so many documents and sources.
MIN_DOCUMENTS, MIN_SOURCES = 20, 5

MASKS = (
    (re.compile(r"https?://\S+|www\.\S+|(?<![\w/])/[\w./-]+"), "⟨u⟩"),
    (re.compile(r"\d{1,4}[-/年.]\d{1,2}[-/月.]\d{1,4}日?|\d{1,2}:\d{2}(?::\d{2})?"), "⟨t⟩"),
    (re.compile(r"(?<![A-Za-z])(?=[a-f]*\d)[0-9a-f]{5,}(?![A-Za-z])|\d+(?:[.,]\d+)*"), "⟨n⟩"),
)
MESSAGE_END = re.compile(r"\n+|(?<=[。！？])|(?<=[.!?])\s+")
CLOSED = regex.compile(r"[\s\p{P}]+")
MASKED_AWAY = regex.compile(r"[\s\p{P}\d]+")


def masked(message: str) -> str:
    """A message with its addresses, dates and numbers masked, in lower case, spaces and punctuation closed up."""
    for pattern, mark in MASKS:
        message = pattern.sub(mark, message)
    return CLOSED.sub(" ", message.lower()).strip()


def messages(text: str) -> list[str]:
    """The sentences and lines of a text."""
    return [m for m in MESSAGE_END.split(text) if len(m.strip()) >= 4]


def folded(text: str) -> str:
    """A text in which what a pattern takes for equal regardless of case is equal."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def anchors_of(pattern: str) -> set[str] | None:
    """Folded literals of which every match of a rule holds one; None if the rule requires none."""
    # The parser of the standard library knows neither flags amid a pattern nor classes of scripts.
    plain_pattern = re.sub(r"\\p\{\w+\}", r"\\w", re.sub(r"\(\?[im]+\)", "", pattern))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)  # "[[" in a class
        found = required_literals(re._parser.parse(plain_pattern))
    return {folded(literal) for literal in found} if found else None


#: The number of the weak rule, beside those of the strong ones.
WEAKLY = -1


class Rules:
    """The rules, behind an automaton that finds in one pass over a text every literal that a rule requires.

    The literals are derived from the patterns; a rule that requires none is tried on every text.
    """

    def __init__(self) -> None:
        self.patterns = [(name, regex.compile(p)) for name, patterns in STRONG.items() for p in patterns]
        self.weak = regex.compile(WEAK)
        #: Rules of wording, which a message can break with its numbers masked and its punctuation closed up.
        self.phrases = {n for n, (name, _) in enumerate(self.patterns) if name != "slot"}
        self.always: set[int] = set()
        groups: dict[str, set[int]] = {}
        numbered = list(enumerate(p for patterns in STRONG.values() for p in patterns))
        for number, pattern in [*numbered, (WEAKLY, WEAK)]:
            literals = anchors_of(pattern)
            if literals is None:
                self.always.add(number)
            for literal in literals or ():
                groups.setdefault(literal, set()).add(number)
        self.anchors = ahocorasick.Automaton()
        for literal, numbers in groups.items():
            self.anchors.add_word(literal, tuple(numbers))
        self.anchors.make_automaton()

    def near(self, text: str) -> set[int]:
        """The rules that a text may break."""
        near = set(self.always)
        for _, numbers in self.anchors.iter(folded(text)):
            near.update(numbers)
        return near

    def broken(self, text: str, near: set[int]) -> str | None:
        """The class of the first strong rule among ``near`` that a text breaks."""
        return next((self.patterns[n][0] for n in sorted(near) if n >= 0 and self.patterns[n][1].search(text)), None)

    def rule(self, text: str) -> str | None:
        """The first class of strong rule that a text breaks."""
        return self.broken(text, self.near(text)) or ("filler" if mock_latin(text) else None)

    def message_hashes(self, text: str, near: set[int]) -> list[tuple[int, str | None]]:
        """Hash and strong class, if any, of each different message of a text that breaks a rule, as it is or masked.

        ``near`` are the strong rules that the text may break as it is. With its punctuation closed up, a text may hold
        literals that it does not hold as it is; masked, it has no digits."""
        closed = self.near(MASKED_AWAY.sub(" ", text)) & (self.phrases | {WEAKLY})
        if not near and not closed:
            return []
        out: dict[int, str | None] = {}
        for message in messages(text):
            strong = self.broken(message, near) if near else None
            own = closed & self.near(MASKED_AWAY.sub(" ", message)) if closed else closed
            if strong or own:
                plain = masked(message)
                if strong or WEAKLY in own and self.weak.search(plain) or self.broken(plain, own):
                    out[signed_hash(plain)] = strong or out.get(signed_hash(plain))
        return list(out.items())

    def rules(self, texts: list[str]) -> list[str | None]:
        out = [self.rule(t) for t in texts]
        for i in repetitive(texts):
            out[i] = out[i] or "filler"
        return out


def signed_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


SENTENCE_END = re.compile(r"(?<=[.!?。])\s+|\n{2,}")
LATIN_ONLY = re.compile(r"[A-Za-z\s,;.!?'-]+")
WORD = re.compile(r"[a-z]+")


def mock_latin(text: str) -> bool:
    """Whether a sentence of plain letters reads like filler: many words, no number, no function word of any language."""
    for sentence in SENTENCE_END.split(text):
        if len(sentence) > 3 * MOCK_WORDS and LATIN_ONLY.fullmatch(sentence):
            words = WORD.findall(sentence.lower())
            if len(words) >= MOCK_WORDS and FUNCTION_WORDS.isdisjoint(words) and len(set(words)) > 2 and sentence.rstrip()[-1] in ".!?" and sum(w.istitle() for w in sentence.split()) <= len(words) // 3:
                return True
    return False


#: A piece of so many characters, said so often in a row, with a letter in it, is filler.
PIECE, TIMES = range(3, 25), 6


def repetitive(texts: list[str]) -> list[int]:
    """The numbers of the texts in which a short piece is repeated. A repeated piece is a stretch
    that equals itself moved by the piece's length; all texts are compared at once."""
    if not texts:
        return []
    joined = "\x00".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found: set[int] = set()
    for piece in PIECE:
        least = piece * (TIMES - 1)
        differs = np.flatnonzero((chars[piece:] != chars[:-piece]) | (chars[piece:] == 0)) if len(chars) > piece else np.zeros(0, np.int64)
        edges = np.concatenate([[-1], differs, [max(len(chars) - piece, 0)]])
        for k in np.flatnonzero(np.diff(edges) > least):
            start = int(edges[k]) + 1
            if any(ch.isalpha() for ch in joined[start : start + piece]):
                found.add(int(np.searchsorted(ends, start, side="right")))
    return sorted(found)


@lru_cache(maxsize=1)
def _rules() -> Rules:
    return Rules()


VERDICT = T.StructType(
    [
        T.StructField("whole", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("rule", T.StringType())]))),
    ]
)


def _verdicts(texts: pd.Series) -> pd.DataFrame:
    rules = _rules()
    lines = texts.fillna("").tolist()
    again = set(repetitive(lines))
    whole, said = [], []
    for i, text in enumerate(lines):
        near = rules.near(text)
        strong = rules.broken(text, near) or ("filler" if mock_latin(text) or i in again else None)
        whole.append(strong)
        said.append(rules.message_hashes(text, near - {WEAKLY} if strong else set()))
    return pd.DataFrame({"whole": whole, "messages": [[{"hash": h, "rule": r} for h, r in m] for m in said]})


def verdict(text: Column) -> Column:
    """What a text shows by itself: ``whole``, the first class of strong rule that it breaks, and ``messages``, the
    ``hash`` of each of its masked messages whose wording breaks a rule, with the class of a strong one that it breaks as it is."""
    # Not moved below a filter on its result, which would run it once more.
    return F.pandas_udf(_verdicts, VERDICT).asNondeterministic()(text)


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", min_documents: int = MIN_DOCUMENTS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """``(doc_key, rule, way)`` of each document whose text is, or contains, residue; ``rule`` names its class.

    Null, empty and blank texts are no case; very long texts are searched
    whole; repeated rows count once; a null source is one source of its own;
    further columns do not matter. To leave such documents out, anti-join.

    ``way`` says what convicts: ``recurring``, a message that stands in at least
    ``min_documents`` documents and ``min_sources`` sources and breaks a weak or
    a strong rule; else ``message``, one that breaks a strong rule, at any
    count; else ``text``, a rule over the whole text. ``rule`` is the strong
    class if the document has one, else ``recurring``. A message that breaks no
    rule convicts nobody, so only the others are counted: over all documents,
    once in each, exactly; a key under two sources counts in either.

    The texts are read once. The messages are written out and grouped: distinct
    ``(hash, source, document)`` first, map-side, so that a message of a third
    of all documents is a few counts; the join back is one of two plain
    shuffles, which the engine splits.
    """
    t = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{key}`").alias("doc_key"), t.alias("text"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).filter(F.col("text").rlike(r"\S"))
    judged = rows.select("doc_key", "source", verdict(F.col("text")).alias("v")).select("doc_key", "source", "v.whole", "v.messages")
    judged = cut(judged.filter(F.col("whole").isNotNull() | (F.size("messages") > 0)))
    said = judged.select("doc_key", "source", F.explode("messages").alias("m")).select("doc_key", "source", "m.hash", "m.rule")
    per_source = said.groupBy("hash", "source").agg(F.count_distinct(F.struct("doc_key")).alias("n"))
    recurring = per_source.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources")).filter((F.col("n") >= min_documents) & (F.col("sources") >= min_sources))
    again = said.select("doc_key", "hash").join(cut(recurring.select("hash")), "hash", "left_semi").select("doc_key", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("way"))
    alone = said.filter("rule is not null").select("doc_key", "rule", F.lit(1).alias("way"))
    whole = judged.filter("whole is not null").select("doc_key", F.col("whole").alias("rule"), F.lit(2).alias("way"))
    found = again.unionByName(alone).unionByName(whole).groupBy("doc_key").agg(F.min("rule").alias("rule"), F.min("way").alias("way"))
    ways = F.array(F.lit("recurring"), F.lit("message"), F.lit("text"))
    return found.select("doc_key", F.coalesce("rule", F.lit("recurring")).alias("rule"), F.element_at(ways, F.col("way") + 1).alias("way"))


def without_residue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` without the documents that :func:`find_residue` finds."""
    found = find_residue(df, key, text, source).select(F.col("doc_key").alias(key))
    return df.join(found, key, "left_anti")
