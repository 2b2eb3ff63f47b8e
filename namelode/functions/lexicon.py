"""Word lists and letter tables of the screening rules."""

from __future__ import annotations

# These lists and tables decide results and have to hold exactly these entries.

#: Patronymic connectors, articles and titles of personal names.
NAME_CONNECTORS = (
    "bin", "bint", "ibn", "ben", "bn", "al", "el", "بن", "بنت", "ابن", "ال", "آل",
    "prince", "princess", "sheikh", "shaikh", "shaykh", "king", "queen", "dr", "mr", "mrs", "ms",
    "الشيخ", "الاميرة", "الامير", "السيد", "السيدة", "الدكتور",
)

#: Legal forms and general business words of organisations' names.
ENTITY_NOISE = (
    "co", "company", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "llp", "plc", "pllc",
    "sa", "gmbh", "ag", "bv", "nv", "sarl", "srl", "ooo", "zao", "pjsc", "cjsc", "jsc", "est", "establishment",
    "trading", "shipping", "transport", "holdings", "holding", "group", "international", "intl",
    "enterprise", "enterprises", "organization", "organisation", "foundation", "association", "society",
    "institute", "services", "solutions", "industries", "industrial", "general", "national", "the", "of", "and", "for",
    "شركة", "شركه", "مؤسسة", "مؤسسه", "منشأة", "منشاة", "مكتب", "مصنع", "معمل",
    "المحدودة", "محدودة", "المسؤولية", "مسؤولية", "ذات", "ذمم", "شمل", "شمم",
    "القابضة", "قابضة", "المجموعة", "مجموعة", "العقارية", "عقارية", "التجارية", "تجارية", "الصناعية", "صناعية",
    "للاستثمار", "الاستثمار", "استثمار", "للاستثمارات", "الاستثمارات", "للتجارة", "التجارة", "للمقاولات", "المقاولات",
    "للخدمات", "الخدمات", "للتنمية", "التنمية", "للتطوير", "التطوير", "للصناعة", "الصناعة",
    "العالمية", "الدولية", "الوطنية", "العامة", "المتحدة", "واولاده", "وشركاه", "واخوانه",
)

#: Name parts taken as common where no measured frequencies are at hand.
COMMON_TOKENS = (
    "mohammed", "mohamed", "muhammad", "mohammad", "mohamad", "muhammed", "ahmed", "ahmad", "ahmet",
    "abdullah", "abdallah", "abdulla", "ali", "hassan", "hasan", "hussain", "hussein", "husain",
    "saad", "saeed", "said", "salem", "salim", "saleh", "salah", "khalid", "khaled", "fahad", "fahd", "nasser", "naser",
    "abdulaziz", "abdulrahman", "abdelrahman", "abdulkarim", "abdullatif", "ibrahim", "ismail", "omar", "othman", "osman",
    "yousef", "yusuf", "mahmoud", "mahmud", "mustafa", "moustafa", "sultan", "turki", "faisal",
    "محمد", "احمد", "عبدالله", "علي", "حسن", "حسين", "سعد", "سعيد", "صالح", "سالم", "خالد", "فهد", "ناصر",
    "عبدالعزيز", "عبدالرحمن", "ابراهيم", "عمر", "عثمان", "يوسف", "محمود", "مصطفى", "سلطان", "فيصل",
)

#: First halves of compound given names, and articles that may stand between the halves.
COMPOUND_PREFIXES = ("عبد", "abd", "abdul", "abdel", "abdal")
ARTICLES = ("ال", "al", "el")
#: Articles written as one with a word.
JOINED_ARTICLES = ("ال", "al", "el")

#: Arabic letters written for one another.
ARABIC_FOLD = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ة": "ه", "ؤ": "و"}
#: Arabic marks without weight: vowel signs, superscript alef, stretching, lone hamza.
ARABIC_MARKS = "[ً-ٰٕـء]"

#: Arabic letters in Latin ones.
ARABIC_LATIN = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d",
    "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "dh", "ع": "a", "غ": "gh",
    "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "u", "ي": "i", "ى": "a", "ة": "a",
    "ء": "", "ئ": "", "ؤ": "u", "ـ": "",
}

#: Two- and three-letter codes under which countries are also known, by name.
COUNTRY_CODES = {
    "Saudi Arabia": ("SA", "SAU"), "United Arab Emirates": ("AE", "ARE"), "Kuwait": ("KW", "KWT"), "Qatar": ("QA", "QAT"),
    "Bahrain": ("BH", "BHR"), "Oman": ("OM", "OMN"), "Yemen": ("YE", "YEM"), "Egypt": ("EG", "EGY"),
    "Jordan": ("JO", "JOR"), "Syria": ("SY", "SYR"), "Iraq": ("IQ", "IRQ"), "Iran": ("IR", "IRN"),
    "Lebanon": ("LB", "LBN"), "Palestine": ("PS", "PSE"), "Sudan": ("SD", "SDN"), "South Sudan": ("SS", "SSD"),
    "Libya": ("LY", "LBY"), "Tunisia": ("TN", "TUN"), "Algeria": ("DZ", "DZA"), "Morocco": ("MA", "MAR"),
    "Somalia": ("SO", "SOM"), "Djibouti": ("DJ", "DJI"), "Eritrea": ("ER", "ERI"), "Ethiopia": ("ET", "ETH"),
    "Turkey": ("TR", "TUR"), "Afghanistan": ("AF", "AFG"), "Pakistan": ("PK", "PAK"), "India": ("IN", "IND"),
    "Bangladesh": ("BD", "BGD"), "Sri Lanka": ("LK", "LKA"), "Nepal": ("NP", "NPL"), "Indonesia": ("ID", "IDN"),
    "Malaysia": ("MY", "MYS"), "Philippines": ("PH", "PHL"), "China": ("CN", "CHN"), "United States": ("US", "USA"),
    "United Kingdom": ("GB", "GBR"), "France": ("FR", "FRA"), "Germany": ("DE", "DEU"), "Italy": ("IT", "ITA"),
    "Spain": ("ES", "ESP"), "Netherlands": ("NL", "NLD"), "Switzerland": ("CH", "CHE"), "Russia": ("RU", "RUS"),
    "Nigeria": ("NG", "NGA"), "Kenya": ("KE", "KEN"), "South Africa": ("ZA", "ZAF"),
}
