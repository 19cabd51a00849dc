"""Values that results depend on."""

# Run types, run states and source names written into the tables.
RUN_TYPES = (
    "parsingEventsFromKontramarka",
    "parsingEventsFromFienta",
    "parsingEventsFromEventim",
)
RUN_STATUSES = ("success", "error", "pending", "processing")
SOURCE_SCHEDULE = "kontramarka"
SOURCE_LISTING = "fienta"
SOURCE_FEED = "eventim"
DEFAULT_SPECIALIZATION = "Event"

# Hosts that links must contain or are completed with.
LISTING_HOST = "fienta.com"
SCHEDULE_HOST = "https://www.kontramarka.de"

# Phrases the filters and the card classifier look for.
EXCLUDED_CITY_PHRASES = ("удаленно", "все города")
ONLINE_PHRASE = "online"
MANY_VENUES_PHRASE = "multiple venues"
MORE_DATES_PHRASES = ("and few more", "one more")
SERIES_PATH = "/s/"
SOLD_OUT_AVAILABILITY = "soldout"
SOLD_OUT_TEXT = "распродан"

# White space as the String.trim and \s of ECMAScript define it.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_CLASS = f"[{WHITESPACE}]"

# Month and weekday names.
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
WEEKDAYS_EN = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS_RU_NOMINATIVE = (
    "январь", "февраль", "март", "апрель", "май", "июнь",
    "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь",
)
MONTHS_RU_GENITIVE = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)

# Sizes.
BATCH_SIZE = 10
DEFAULT_PER_PAGE = 20
MAX_PER_PAGE = 100
DEFAULT_RETENTION_DAYS = 30
DEFAULT_CITY_SORT = 999
UNKNOWN_COORDINATE = "0"
LABEL_LENGTH = 100
