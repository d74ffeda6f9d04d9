"""Word lists, tables, patterns and formats the results depend on.

Everything here is data, stated as plain text. Regular expressions are in Java
syntax, which is what Spark's regular-expression functions run.
"""

# ---------------------------------------------------------------- categories
CATEGORIES = ["姓名", "身分證", "手機", "市話", "地址", "電子郵件", "公司", "統編", "識別碼",
              "國際電話", "信用卡", "SSN", "IBAN", "IP", "生日"]

# ---------------------------------------------------------------- characters
# White space as JavaScript's \s sees it; Java's own \s is ASCII only.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CJK = r"\x{4e00}-\x{9fa5}"

# ------------------------------------------------------------------- address
CITIES = (
    "(?:[臺台]北市|新北市|桃園市|[臺台]中市|[臺台]南市|高雄市|基隆市|新竹[市縣]|嘉義[市縣]|苗栗縣|彰化縣|南投縣"
    "|雲林縣|屏東縣|宜蘭縣|花蓮縣|[臺台]東縣|澎湖縣|金門縣|連江縣)"
)
DISTRICT = rf"(?:[{CJK}]{{1,4}}[鄉鎮市區])?"
ROAD = rf"(?:[{CJK}\d]{{1,8}}(?:路|街|大道))"
VILLAGE = rf"(?:[{CJK}]{{1,4}}[村里])?(?:\d{{1,3}}鄰)?"
HOUSE = (
    r"(?:[一二三四五六七八九十\d]{1,3}段)?(?:\d{1,4}巷)?(?:\d{1,4}弄)?"
    r"\d{1,5}(?:之\d{1,3})?號(?:[\d一二三四五六七八九十]{1,3}樓)?(?:之\d{1,3})?"
    rf"(?:[{CJK}\d]{{1,3}}室)?"
)
ADDRESS = rf"(?:{CITIES}{DISTRICT}{VILLAGE}{ROAD}?|(?<![{CJK}]){DISTRICT}{ROAD}){VILLAGE}{HOUSE}"
DISTRICT_PREFIX = r"^[一-龥]{1,4}?[鄉鎮市區]"

# -------------------------------------------------------------------- phones
AREA = "(?:826|836|82|89|37|49|[2-8])"
MOBILE = r"(?<![\d+])(?:\+886[-\x20]?9|09)\d{2}[-\x20]?\d{3}[-\x20]?\d{3}(?!\d)"
LANDLINE = (
    rf"(?<![\d(])(?:\(0{AREA}\)[-\x20]?\d{{3,4}}[-\x20]?\d{{3,4}}"
    rf"|0{AREA}[-\x20]\d{{3,4}}[-\x20]?\d{{3,4}}"
    r"|0[24]\d{8}|0[3-8]\d{7}|08[29]\d{6}|08[23]6\d{5}"
    rf"|\+886[-\x20]?\(?0?{AREA}\)?[-\x20]?\d{{3,4}}[-\x20]?\d{{3,4}})(?!\d)"
)
INTL_PHONE = (
    r"(?<![\w+])(?:\+[1-9]\d{0,2}(?:[\x20.-]?(?:\(\d{1,4}\)|\d{1,5})){1,6}"
    r"|(?:\(\d{3}\)\x20?|\d{3}[-.\x20])\d{3}[-.\x20]\d{4})(?!\w)"
)

# -------------------------------------------------- identifiers and accounts
TW_ID = r"(?<![A-Za-z0-9])[A-Z][12]\d{8}(?!\d)"
TAX_ID = r"(?<![\d-])\d{8}(?![\d-])"
SSN = r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{3}\x20\d{2}\x20\d{4})(?![\d-])"
SSN_LABEL = rf"(?:SSN|Social Security (?:Number|No\.?)){WS}*+(?:[#:：]{WS}*+)?"
SSN_BARE = r"\d{9}(?!\d)"
CARD = r"(?<![\d-])\d(?:[\x20-]?\d){12,18}(?![\d-])"
# Visa, Mastercard, American Express, Discover, JCB, UnionPay, Diners Club.
CARD_PREFIX = (
    r"^(?:4|5[1-5]|2(?:2[2-9][1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)|3[47]|6011|65|64[4-9]"
    r"|35(?:2[89]|[3-8]\d)|62|30[0-5]|36|38)"
)
# Printed group shapes: 4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4, 4-4-4-1, 4-4-4-2, 4-4-4-3.
CARD_SHAPE = (
    r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1(?:\d{4}(?:\1\d{3})?|\d{1,3})|\d{4}([ -])\d{6}\2\d{4,5})$"
)
IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
)
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
    "VG": 24, "XK": 20,
}
# Letters of the Taiwan national ID in the order of their values 10, 11, 12 …
TW_ID_LETTERS = "ABCDEFGHJKLMNPQRSTUVXYWZIO"

# --------------------------------------------------- e-mail and IP addresses
# A match begins where a run of local characters begins or where the match before it ended, so a run without @ is read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"

# ------------------------------------------------------------ dates of birth
MONTH = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
    "|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
BIRTH_WORDS = (
    r"(?:DOB|D\.O\.B\.?|[Dd]ate [Oo]f [Bb]irth|[Bb]irth ?[Dd]ate|[Bb]irthday|[Bb]orn(?: [Oo]n)?"
    r"|出生日期|出生年月日|生日)"
)
BIRTH_LABEL = rf"{BIRTH_WORDS}[\x20\t]*+(?:[:：][\x20\t]*+)?"
BIRTH_DATE = (
    rf"(?:(?:民國{WS}*)?\d{{2,4}}{WS}*年{WS}*\d{{1,2}}{WS}*月{WS}*\d{{1,2}}{WS}*日?"
    r"|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
    rf"|{MONTH}\.?\x20+\d{{1,2}}(?:st|nd|rd|th)?,?\x20+\d{{4}}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?\x20+{MONTH}\.?,?\x20+\d{{4}})"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# ------------------------------------------------------------- organisations
COMPANY_SUFFIX = (
    "(?:股份有限公司|有限公司|無限公司|兩合公司|企業社|工作室|事務所|商行|診所|基金會|協會|合作社|工程行|企業行|實業社|文化事業)"
)
COMPANY_NOT_FIRST = "的與和及於在由向從為對將把讓依據至到給經受同各該本貴我敝此其係即為者以並或如"
COMPANY = rf"(?:(?![{COMPANY_NOT_FIRST}])[{CJK}A-Za-z0-9&·]){{2,14}}?{COMPANY_SUFFIX}"

# --------------------------------------------------------------------- names
COMPOUND_SURNAMES = ["歐陽", "司馬", "諸葛", "上官", "張簡", "范姜", "司徒", "東方", "令狐", "南宮", "端木", "皇甫", "尉遲", "夏侯"]
SINGLE_SURNAMES = (
    "陳林黃張李王吳劉蔡楊許鄭謝郭洪邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾游彭詹胡施沈余盧梁趙顏柯翁魏孫戴范方宋鄧杜傅侯曹薛丁卓阮馬董溫唐藍蔣石"
    "古紀姚連馮歐程湯田康姜白汪鄒尤巫鐘黎塗龔嚴韓袁金童陸夏柳邵錢伍倪甘秦官辛戚易祝樊喬向殷凌闕舒包鮑冉牛管毛涂"
)
# What commonly follows a name.
NAME_FOLLOW = (
    rf"(?=\z|{WS}|[\d\p{{P}}A-Za-z]"
    "|先生|小姐|女士|同學|醫師|醫生|護理師|老師|律師|經理|主任|董事|總監|組長|課長|科長|處長|局長|部長|教授|博士|君|兄|姐|哥|等|表示|說|指出|認為"
    "|於|在|與|和|及|為|所|之|的|已|將|曾|因|向|由|係|即|亦|並|或|另|也|則|更|未|不|有|無|是|非|對|從|自|以|被|經|卻|還|又|再|但|而|才|都|皆|均|便|就"
    "|會|能|可|應|須|要|想|願|正|到|來|去|至|提|收|付|持|稱|同意|聲明|陳述|申請|提供|前往|出席|簽|辦理|負責|擔任|購買|支付|領取|遞交|回覆|聯絡|通知|告知)"
)
# Characters that do not occur in a given name.
NAME_STOP_CHARS = (
    "的了是在有和與及於為等所之已將因向由係即亦並或另也則未不無非對從自以被經卻還又再但而才都皆均便就會能可應須要想願到來去至收付持稱接提說表指認出簽"
    "辦負擔購支領遞回聯通告這那該此其每各們呢嗎吧啊麼什怎很太最曾先女士請讓使給把被令將於當若如則個"
)
NAME = (
    rf"(?:{'|'.join(COMPOUND_SURNAMES)}|[{SINGLE_SURNAMES}])"
    rf"(?:[{CJK}]{{1,2}}{NAME_FOLLOW}|(?:(?![{NAME_STOP_CHARS}])[{CJK}]){{2}})"
)
# Words that begin like a name but are none. Only words that begin with a surname
# can ever be compared, so only those are listed.
NAME_STOP_WORDS = (
    "王國 王子 王牌 李子 張開 張貼 張力 陳述 陳列 陳舊 林口 林業 林地 "
    "高雄 高速 高中 高級 高度 高溫 高血 黃金 黃色 黃昏 吳郭 何時 何況 "
    "何人 何處 何等 何種 何者 何以 何不 何在 何其 何去 "
    "何謂 馬上 馬路 周年 周末 周邊 周圍 方法 方面 方向 方式 方案 許多 "
    "許可 江山 江湖 白色 白天 白血 金門 金額 金融 金屬 金錢 "
    "石頭 程式 程度 康復 施工 施行 羅列 夏天 "
    "夏季 田地 余額 毛病 古代 古蹟 紀錄 紀念 連結 連續 "
    "連接 連線 溫度 溫暖 唐朝 藍色 石油 康健 姜母 汪洋 童年 陸地 "
    "柳樹 錢包 甘心 秦朝 官方 官員 易於 祝福 喬木 向來 凌晨 舒服 包含 "
    "包括 包裝 鮑魚 牛肉 牛奶 管理 毛巾 柯南 翁婿 魏晉 孫子 戴上 范圍 "
    "宋朝 杜絕 侯爵 曹操 丁點 卓越 馬克 董事 藍圖 蔣公 石膏 鄧小 傅立 "
    "梁柱 趙錢 顏色 簡單 簡介 簡稱 朱紅 鍾情 游泳 游戲 詹姆 胡說 胡椒 "
    "沈默 盧比 呂宋 江西 何必 蕭條 羅馬 潘朵 莊園 蘇打 葉子 "
    "徐徐 廖化 賴床 曾經 洪水 郭台 謝謝 鄭重 許願 蔡英 劉海 吳哥 楊桃 "
    "張三 李四 王五 謝絕 謝意 許久 賴以 曾任 洪流 邱比 徐步 廖若 莊嚴 "
    "管轄 管制 管線 管道 管控 溫濕 溫馨 溫室 何疑 易雙 謝您 謝函 謝禮 高層 高額 "
    "方為 牛市 包商 向下 向上 程師 簡訊 向本"
).split()
# "X方" names a party to a contract; "X何" is an adverb or a question word.
PARTY_BEFORE = "[甲乙丙丁雙各買賣我他貴對本該多官軍校院廠資勞前後男女一二三四五六七八九十任另每]$"
HE_BEFORE = "[任如為幾若奈無]$"

# ----------------------------------------------------- codes, markers, files
MARKER = r"\[([^\[\]:]{1,10}):([0-9a-f]{6})\]"
CODE_LENGTH = 6
BLANK = "○"
MAPPING_HEADERS = ["code", "category", "original"]
KEPT_HEADERS = ["kept_prefix", "kept_suffix"]
FORMAT_BY_EXTENSION = {"txt": "txt", "md": "md", "markdown": "md", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf"}
MAX_FILE_BYTES = 100 * 1024 * 1024
PASTED_NAME = "貼上的文字.txt"
MERGED_MAPPING_NAME = "合併編碼表.mapping.csv"
MANIFEST_HEADERS = ["檔案", "去識別化檔", "編碼表", "生效筆數", "部分保留"]

# --------------------------------------------------- look-alikes of the digits
LOOKALIKE_LETTERS = "OoDQIli|ZzSsGBgq"
LOOKALIKE_DIGITS = "0000111122556899"
LOOKALIKE_TOKEN = r"(?<![0-9A-Za-z|])[0-9A-Za-z|][0-9A-Za-z|-]{7,13}(?![0-9A-Za-z|])"
LOOKALIKE_PHONE = r"^(?:09\d{2}-?\d{3}-?\d{3}|0\d{1,3}-?\d{3,4}-?\d{3,4})$"

# -------------------------------------------------- recognised words to lines
SPLIT_GAP = 1.5
SPACE_GAP = 0.8
NUMBER_GAP = 0.2
MIN_SYMBOL_CONFIDENCE = 60
WIDE_CHARS = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]"
SYMBOLS_ONLY = r"^[^\p{L}\p{N}]+$"
RULE_CHARS = "[|｜_＿=~]"
EDGE_NOISE = '^[|｜]+|[|｜]+$|^[「“"]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9.])[」”"]+$'

# -------------------------------------------------------- retention texts
MODE_LABELS = {
    "none": "全部隱藏", "ends": "保留前／後幾碼", "delim": "以分隔字元為界", "surname": "保留姓氏",
    "city": "保留到縣市", "district": "保留到縣市＋鄉鎮市區", "preview": "部分保留（標準）",
}
