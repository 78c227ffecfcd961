"""Words, patterns, codes and limits that results depend on literally."""

# --- fixed values: name folding ------------------------------------------------------------
TYPE_WORDS = ["うなぎ", "鰻", "割烹", "食堂", "レストラン", "料理店", "居酒屋", "喫茶店", "カフェ"]
BRANCH_WORDS = ["本店", "支店", "駅前店", "別館", "新館"]
KEPT_CHARACTERS = "0-9a-z\\u3040-\\u30ff\\u3400-\\u9fff"

# --- fixed values: pair scoring ------------------------------------------------------------
EARTH_RADIUS_M = 6371000.0
PHONE_POINTS = 52.0
NAME_POINTS = 25.0
ADDRESS_POINTS = 35.0
DISTANCE_POINTS = 52.0
CONTAINMENT_FLOOR = 0.88
CONTAINMENT_SPAN = 0.12
HIGH_SCORE = 75.0
MEDIUM_SCORE = 52.0
DIRECT_SCORE = 98.0
REASON_DIRECT = "Google Maps 直接提供 Tabelog 店家連結"
REASON_PHONE = "電話完全相同"
REASON_NAME = "店名高度相似"
REASON_ADDRESS = "地址高度相似"
REASON_DISTANCE = ("座標相距 ", " 公尺")
REASON_WEBSITE = "官方網站完全相同"
REASON_RELOCATED = "Tabelog 標示為移轉前資料"
REASON_REVIEWED_DUPLICATE = "同址重複頁面中評論資料較完整"

# --- fixed values: award guide -------------------------------------------------------------
GUIDE_BASE_URL = "https://guide.michelin.com"
GUIDE_LIST_URL = "https://guide.michelin.com/tw/zh_TW/selection/japan/restaurants"
GUIDE_LANGUAGE = "zh_TW"
GUIDE_SCOPE = "Japan"
DISTINCTION_LABELS = {
    "THREE_STARS": "米其林三星",
    "TWO_STARS": "米其林二星",
    "ONE_STAR": "米其林一星",
    "BIB_GOURMAND": "必比登推介",
    "SELECTED": "米其林指南入選",
}
AWARD_RADIUS_M = 500.0
CLOSE_RADIUS_M = 35.0
DETAIL_RADIUS_M = 100.0

# --- fixed values: listing site ------------------------------------------------------------
LISTING_URL_PATTERN = (
    r"(?i)https?://tabelog\.com/(?:en/|tw/|cn/|kr/)?([a-z0-9-]+/A\d+/A\d+/\d+)/?"
)
LISTING_PAGE_HOSTS = ["tabelog.com", "www.tabelog.com"]
AWARD_LINK_PATTERN = r"(?i)https?://award\.tabelog\.com/hyakumeiten/([^/]+)/(20\d{2})/?"
AWARD_LABEL_PATTERN = r"^(?:食べログ\s*)?(.+?)\s*百名店\s*(20\d{2})\s*選出店$"
CATEGORY_LINK_PATTERN = (
    r"(?i)/(?:en/|tw/|cn/|kr/)?[a-z0-9-]+/A\d+/A\d+/\d+/peripheral_map/"
    r"([a-z][a-z0-9_-]*)/?(?:[?#].*)?$"
)
GENERIC_BOOKING_PATHS = [
    "/ai_request_booking/guide/index",
    "/yoyaku/tabelog_booking/send_remind",
]
PAYMENT_MARKERS = "カード|クレジットカード|電子マネー|QRコード決済"
PAYMENT_KINDS = {
    "cards": ["カード", "クレジットカード"],
    "electronic_money": ["電子マネー"],
    "qr_code": ["QRコード決済"],
}
RELOCATION_NOTICE = "移転前の店舗情報"

# --- fixed values: cuisine words -----------------------------------------------------------
GENRE_SLUGS = {
    "和食": "washoku", "日本料理": "japanese", "寿司": "sushi", "鮨": "sushi",
    "海鮮・魚介": "seafood", "海鮮": "seafood", "そば（蕎麦）": "soba", "そば": "soba",
    "うなぎ": "unagi", "焼き鳥": "yakitori", "お好み焼き": "okonomiyaki",
    "もんじゃ焼き": "monjya", "洋食": "yoshoku", "フレンチ": "french",
    "イタリアン": "italian", "スペイン料理": "spain", "ステーキ": "steak",
    "中華料理": "chinese", "韓国料理": "korea", "タイ料理": "thai",
    "ラーメン": "ramen", "カレー": "curry", "もつ鍋": "motsu", "鍋": "nabe",
    "居酒屋": "izakaya", "パン": "pan", "スイーツ": "sweets", "バー・お酒": "bar",
    "天ぷら": "tempura", "焼肉": "yakiniku", "料理旅館": "ryokan", "ビストロ": "bistro",
    "ハンバーグ": "hamburgersteak", "ハンバーガー": "hamburger", "とんかつ": "tonkatsu",
    "串揚げ": "kushiage", "うどん": "udon", "しゃぶしゃぶ": "syabusyabu",
    "沖縄料理": "okinawafood", "パスタ": "pasta", "ピザ": "pizza", "餃子": "gyouza",
    "ホルモン": "horumon", "カフェ": "cafe", "喫茶店": "kissaten", "ケーキ": "cake",
    "タピオカ": "tapioca", "食堂": "teishoku", "ビュッフェ・バイキング": "viking",
}
BROAD_GENRES = [
    "カフェ", "喫茶店", "バー", "バル", "バー・お酒", "ダイニングバー", "居酒屋", "食堂", "レストラン",
]
GENRE_LABELS = {
    "アメリカ料理": "美式料理", "イタリアン": "義大利料理", "インド料理": "印度料理",
    "うどん": "烏龍麵", "うなぎ": "鰻魚料理", "カフェ": "咖啡廳", "韓国料理": "韓國料理",
    "割烹・小料理": "割烹／小料理", "串焼き": "串燒", "ケーキ": "蛋糕", "シーフード": "海鮮料理",
    "スペイン料理": "西班牙料理", "ステーキ": "牛排", "スイーツ": "甜點", "そば": "蕎麥麵",
    "タイ料理": "泰式料理", "チョコレート": "巧克力", "てんぷら": "天婦羅", "とんかつ": "炸豬排",
    "バー": "酒吧", "ハンバーガー": "漢堡", "パン": "麵包", "ビストロ": "小酒館",
    "フレンチ": "法式料理", "ベトナム料理": "越南料理", "メキシコ料理": "墨西哥料理",
    "ラーメン": "拉麵", "レストラン": "餐廳", "中華料理": "中式料理", "中国料理": "中式料理",
    "喫茶店": "咖啡店", "寿司": "壽司", "天ぷら": "天婦羅", "天婦羅": "天婦羅",
    "居酒屋": "居酒屋", "日本料理": "日本料理", "洋食": "西式料理", "焼き鳥": "烤雞肉串",
    "焼肉": "燒肉", "豚料理": "豬肉料理", "鳥料理": "雞肉料理", "餃子": "餃子",
}
LEGACY_CATEGORY_LABELS = {"ハンバーガー": "漢堡"}

# --- fixed values: places and stations -----------------------------------------------------
PREFECTURE_PATTERN = r"(?:東京都|北海道|(?:京都|大阪)府|.{2,3}県)"
ADDRESS_AREA_PATTERN = r"(?:〒\s*\d{3}-?\d{4}\s*)?([^\s,，]{2,12}?[都道府県])"
LOCALITY_PATTERN = r"^([^\p{Nd}\s　,，]{1,14}?(?:区|市|町|村))"
QUOTED_STATION_PATTERN = r"[「『]([^」』]+)[」』]"
LINE_STATION_PATTERN = (
    r"^(?:(?:JR|東京メトロ|都営(?:地下鉄)?|東急|京王|京急|小田急|西武|東武|相鉄|京成)[^「『]*線)(.+?駅?)$"
)

# --- fixed values: country rules -----------------------------------------------------------
COUNTRY_BOX = {"south": 20.0, "north": 46.5, "west": 122.0, "east": 154.5}
COUNTRY_URL_PATTERN = r"^https://tabelog\.com/(?i:[a-z0-9-]+/A\d+/A\d+/\d+/)"
COUNTRY_PHONE_PATTERN = r"(?:^|[^\d])\+81(?:[\s()\-]|\d)"
COUNTRY_POSTCODE_PATTERN = r"〒\s*\d{3}\s*[-‐‑–—]?\s*\d{4}"
COUNTRY_ADDRESS_PATTERN = (
    r"\bJapan\b|日本|北海道|(?:東京都|京都府|大阪府)|"
    r"(?:青森|岩手|宮城|秋田|山形|福島|茨城|栃木|群馬|埼玉|千葉|神奈川|新潟|"
    r"富山|石川|福井|山梨|長野|岐阜|静岡|愛知|三重|滋賀|兵庫|奈良|和歌山|鳥取|"
    r"島根|岡山|広島|山口|徳島|香川|愛媛|高知|福岡|佐賀|長崎|熊本|大分|宮崎|"
    r"鹿児島|沖縄)県"
)

# --- fixed values: dining category rules ---------------------------------------------------
DINING_CATEGORY_PATTERNS = [
    "(?i)(?:餐廳|餐厅|餐館|餐馆|食堂|飯館|饭馆|小吃店|美食廣場|美食广场|咖啡店|咖啡廳|咖啡厅|咖啡館|咖啡馆|"
    "茶館|茶馆|茶屋|酒吧|居酒屋|啤酒館|啤酒馆|麵包店|面包店|烘焙坊|甜品店|甜點店|甜点店|冰品店|冰淇淋店|蛋糕店|"
    "糕餅店|糕饼店|餅店|饼店|拉麵店|拉面店|三明治店|便當店|便当店|熟食店|外賣店|外卖店|飲料店|饮料店|果汁店|"
    "餐飲服務|餐饮服务)",
    r"(?i)(?:\b(?:restaurant|cafe|coffee shop|tea house|tea room|bar|pub|izakaya|diner|eatery|food court|"
    r"bakery|dessert shop|ice cream shop|donut shop|takeout|meal delivery|caterer|bistro|brasserie|"
    r"pizzeria|steakhouse|grill|ramen|sushi)\b|café)",
    "(?:レストラン|食堂|料理店|飲食店|居酒屋|カフェ|喫茶店|茶屋|バー|パブ|パン屋|ベーカリー|菓子店|ケーキ屋|弁当屋|"
    "惣菜店|ラーメン店|寿司店|蕎麦店|うどん店|焼肉店|カレー店)",
    "(?:음식점|식당|카페|커피숍|술집|바|펍|베이커리|제과점|아이스크림 가게)",
]
MENU_LABEL_PATTERN = "(?i)^(?:菜單|菜单|メニュー|menu|메뉴)(?:$|[·・:：])"
PER_PERSON_LABEL_PATTERN = r"(?i)(?:每人|1\s*人(?:あたり|当たり)|per\s+person|1인당).*(?:¥|￥|\$|€|£|₩)"
DINE_IN_LABEL_PATTERN = (
    r"(?i)(?:提供內用|提供堂食|可內用|可堂食|店内飲食可|イートイン可|offers?\s+dine-in|"
    r"dine-in\s+available|매장\s*내\s*식사\s*가능)"
)

# --- fixed values: numerals ----------------------------------------------------------------
NUMERAL_DIGITS = {
    "零": "0", "〇": "0", "○": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7",
    "八": "8", "九": "9", "兩": "2", "两": "2",
}
NUMERAL_UNITS = {
    "十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000, "億": 100000000, "亿": 100000000,
}
NUMERAL_POINTS = "點点"
NUMERAL_RUN_PATTERN = "[零〇○一二三四五六七八九兩两十百千萬万億亿點点]+"

# --- fixed values: keys, lifetimes and limits ----------------------------------------------
ADVICE_KEY_VERSION = "zh-Hant-v3"
REVIEW_KEY_VERSION = "review-insights-v1"
HOST_GAP_SECONDS = 0.8
REQUEST_BYTES_MAX = 16384
BATCH_CARDS_MAX = 10
SIMILAR_POOL = 30
SIMILAR_SHOWN = 6
REVIEW_TEXT_MAX = 480
REVIEW_COUNT_MAX = 20
REVIEW_TOTAL_MAX = 9000
REVIEW_TAIL_MIN = 40
REVIEW_NOTE = "僅分析一頁公開評論，可能不完整"
ADVICE_HEADLINE = "用餐建議"
