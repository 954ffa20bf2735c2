"""Fixed values of the spoken form: tables of the language that must be as they are for right results.

Each is a parameter's default somewhere in ``rewrite``; another language brings its own."""

from __future__ import annotations

# fixed values: marks that are straightened, and symbols that are spoken
TIDY = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "."), ("\xa0", " "))
SYMBOLS = {"&": " və ", "№": " nömrə ", "§": " paraqraf ", "×": " vurulsun ", "÷": " bölünsün ", "±": " artı mənfi ", "≈": " təxminən ", "≤": " kiçik və ya bərabər ", "≥": " böyük və ya bərabər ", "=": " bərabərdir ", "°": " dərəcə "}

# fixed values: number words in the order of their value, endings of ordinals by the last vowel, places of decimals
ONES = ("", "bir", "iki", "üç", "dörd", "beş", "altı", "yeddi", "səkkiz", "doqquz")
TENS = ("", "on", "iyirmi", "otuz", "qırx", "əlli", "altmış", "yetmiş", "səksən", "doxsan")
SCALES = ("", "min", "milyon", "milyard", "trilyon", "kvadrilyon")
HUNDRED, ZERO, MINUS, PLUS, WHOLE, DIVIDED, TO, DOT, PERCENT, YEAR = "yüz", "sıfır", "mənfi", "üstəgəl", "tam", "bölü", "ilə", "nöqtə", "faiz", "il"
ORDINAL = {"a": "ncı", "ı": "ncı", "e": "nci", "ə": "nci", "i": "nci", "o": "ncu", "u": "ncu", "ö": "ncü", "ü": "ncü"}
ORDINAL_SUFFIXES = ("cı", "ci", "cu", "cü", "ncı", "nci", "ncu", "ncü", "ıncı", "inci", "uncu", "üncü")
PLACES = ("onda", "yüzdə", "mində")
MONTHS = ("yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul", "avqust", "sentyabr", "oktyabr", "noyabr", "dekabr")

# fixed values: abbreviations and what they stand for
ABBREVIATIONS = {
    "və s.": "və sairə", "və b.": "və başqaları", "və i.a.": "və iləaxır", "məs.": "məsələn", "e.ə.": "eramızdan əvvəl", "b.e.ə.": "bizim eradan əvvəl", "prof.": "professor", "dos.": "dosent",
    "akad.": "akademik", "dr.": "doktor", "küç.": "küçə", "şəh.": "şəhər", "r-nu": "rayonu", "mkr.": "mikrorayon", "səh.": "səhifə", "bax:": "bax,",
}

# fixed values: units and scales after a number
UNITS = {
    "kq": "kiloqram", "q": "qram", "t": "ton", "mq": "milliqram", "km": "kilometr", "m": "metr", "sm": "santimetr", "mm": "millimetr", "l": "litr", "ml": "millilitr",
    "san": "saniyə", "dəq": "dəqiqə", "st": "ədəd", "kv.m": "kvadrat metr", "kub.m": "kub metr", "ha": "hektar", "kvt": "kilovatt", "vt": "vatt", "hz": "herts",
    "gb": "giqabayt", "mb": "meqabayt", "kb": "kilobayt", "tb": "terabayt", "°c": "dərəcə selsi", "°f": "dərəcə farenheyt",
    "km/saat": "kilometr saatda", "km/s": "kilometr saniyədə", "m/s": "metr saniyədə", "mln": "milyon", "mlrd": "milyard", "trln": "trilyon",
}

# fixed values: currencies and their coins
CURRENCIES = {
    "azn": "manat", "₼": "manat", "usd": "dollar", "$": "dollar", "eur": "avro", "€": "avro", "gbp": "funt sterlinq", "£": "funt sterlinq",
    "rub": "rubl", "₽": "rubl", "try": "Türkiyə lirəsi", "₺": "Türkiyə lirəsi",
}
COINS = {"manat": "qəpik", "dollar": "sent", "avro": "sent", "rubl": "qəpik", "funt sterlinq": "pens", "Türkiyə lirəsi": "quruş"}

# fixed values: names of letters, and acronyms that are not spelled
LETTER_NAMES = {
    "a": "a", "b": "be", "c": "ce", "ç": "çe", "d": "de", "e": "e", "ə": "ə", "f": "fe", "g": "ge", "ğ": "ğe", "h": "he", "x": "xe", "ı": "ı", "i": "i", "j": "je", "k": "ka", "q": "qe",
    "l": "el", "m": "em", "n": "en", "o": "o", "ö": "ö", "p": "pe", "r": "er", "s": "se", "ş": "şe", "t": "te", "u": "u", "ü": "ü", "v": "ve", "y": "ye", "z": "ze",
}
ACRONYMS = {"AMEA": "a em e a", "ADA": "ada", "ASAN": "asan", "NATO": "nato", "UNESCO": "yunesko", "UNICEF": "yunisef", "COVID": "kovid", "PIN": "pin", "SIM": "sim"}

# fixed values: foreign words as they are said
FOREIGN_WORDS = {
    "microsoft": "maykrosoft", "google": "qugl", "gmail": "cimeyl", "youtube": "yutub", "facebook": "feysbuk", "instagram": "instaqram", "whatsapp": "vatsap", "telegram": "teleqram",
    "tiktok": "tiktok", "twitter": "tvitter", "linkedin": "linkedin", "github": "githab", "wikipedia": "vikipediya", "netflix": "netfliks", "spotify": "spotifay", "zoom": "zum",
    "skype": "skayp", "chatgpt": "çat ci pi ti", "openai": "open ey ay", "iphone": "ayfon", "ipad": "aypad", "apple": "eppl", "samsung": "samsunq", "windows": "vindovs",
    "linux": "linuks", "excel": "eksel", "photoshop": "fotoşop", "playstation": "pleysteyşn", "paypal": "peypal", "mastercard": "masterkard", "nike": "nayk", "coca-cola": "koka-kola",
    "wolt": "volt", "wi-fi": "vayfay", "wifi": "vayfay", "bluetooth": "blutuz", "e-mail": "imeyl", "email": "imeyl", "online": "onlayn", "offline": "oflayn", "hashtag": "heşteq",
    "selfie": "selfi", "startup": "startap",
}

# fixed values: nouns before which a lone letter is a numeral, and words that begin a new part of a long sentence
ROMAN_NOUNS = ("əsr", "sinif", "kurs", "hissə", "fəsil", "bölmə", "cild", "maddə", "dərəcə", "qrup", "rüb", "yarımil", "mərtəbə")
CONJUNCTIONS = ("və", "amma", "ancaq", "lakin", "çünki", "ki", "ya", "yaxud", "ona görə", "buna görə", "həmçinin", "yəni")

# fixed values: patterns of written forms that must match as they are
PHONE_ABROAD, PHONE = r"\+\d[\d\s\-()]{7,}\d", r"\(?0\d{2}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
GROUPED = r"[1-9]\d{0,2}(?:(?:[ \xa0]\d{3})+(?!\d)|(?:\.\d{3})+(?!\d|\.\d)|(?:,\d{3}){2,}(?!\d|,\d))"
DATE_ISO, DATE_DMY = r"(\d{4})-(\d{2})-(\d{2})(?!\d)", r"(\d{1,2})(?<sep>[./-])(\d{1,2})\k<sep>(\d{4}|\d{2})(?!\d|[./]\d)"
DATE_DM, DAY_PADDED = r"(\d{1,2})/(0[1-9])(?![\d/])", r"0\d"
YEAR_FORMS = "(?:in|də|dən|i|ə)?"
AMOUNT_SCALES = r"(?:mln|mlrd|trln|milyon|milyard|trilyon|min)\.?"
ROMAN_NUMERAL = "^(?:[IVX]|(?=[IVXL]{2,})(?:XL|L?X{0,4})(?:IX|IV|V?I{0,3}))$"
FRACTION = r"(\d+)/(\d+)(?![\d/]|[.,]\d)"
