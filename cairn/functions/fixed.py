"""What pages of this kind are written with. Word lists, lookup tables and formats; no logic.

Names of people and hosts that only one collection uses are no part of this: they are parameters.
"""

from __future__ import annotations

# Site types, in order of precedence.
SITE_TYPES = ("resurgence & sink", "shaft, cave", "cave/dig", "rock shelter", "depression", "resurgence", "collapse", "shelter", "shafts", "caves", "sinks", "holes", "rifts", "digs", "shaft", "cave", "rift", "sink", "hole", "dig")
# Measurement labels.
MEASUREMENTS = {"length": "length", "depth": "depth", "altitude": "altitude", "alt.": "altitude", "alt": "altitude", "height": "height", "height range": "height_range", "vertical range": "vertical_range"}
# Misspelt months.
MONTH_TYPOS = {"febrary": 2, "febuary": 2, "febraury": 2, "januray": 1, "octber": 10, "septmber": 9, "aprl": 4, "novemebr": 11, "decemeber": 12}
# Notes on where a record lies, not bibliography.
PROVENANCE = {"material in file", "card", "cards", "card/material in file", "file", "in file", "pers comm", "pers comm.", "personal communication", "none", "no reference", "sead website", "acanto web site", "survey", "photo", "photos", "logbook", "log book", "see log book", "unknown", "?"}
# Link texts that attach to the citation before them.
ATTACHMENTS = {"survey", "surveys", "survey and photo", "survey and photos", "survey and drawings", "sketch", "photo", "photos", "plan", "elevation"}
# Qualifiers of citations that are known.
QUALIFIERS = (
    "easter logbook", "summer logbook", "autumn logbook", "spring logbook", "winter logbook", "christmas logbook", "xmas logbook", "whit logbook", "january logbook", "february logbook", "january, february logbook",
    "spring, summer logbook", "autumn + christmas logbook", "easter and summer logbooks", "easter & summer", "easter and summer", "logbook", "log book", "survey", "surveys", "photo", "photos", "survey and photo",
    "survey and photos", "survey and drawings", "volume 1 and volume 2", "sketch", "?",
)
# Footer labels and the names of their fields.
LABELS = {"reference": "references", "references": "references", "entrance picture": "entrance_pictures", "entrance pictures": "entrance_pictures", "entrance picture(s)": "entrance_pictures", "entrance pictures(s)": "entrance_pictures", "underground picture": "underground_pictures", "underground pictures": "underground_pictures", "underground picture(s)": "underground_pictures", "video": "video", "video(s)": "video", "videos": "video", "detailed survey": "detailed_survey", "detailed surveys": "detailed_survey", "line survey": "line_survey", "on area survey": "on_area_survey", "on area map": "on_area_survey", "survex file": "survex_file", "passage direction rose diagram": "rose_diagram", "hydrology": "hydrology", "archaeology": "archaeology", "archaeological remains": "archaeology", "sketch survey": "sketch_survey", "survey": "survey", "surveys": "survey", "survex files": "survex_file", "entrance video": "entrance_video", "entrance videos": "entrance_video", "underground video": "underground_video", "underground videos": "underground_video", "miscellaneous": "miscellaneous", "misc": "miscellaneous", "misc. pic": "miscellaneous", "other pictures": "other_pictures", "pictures": "other_pictures", "entrance and other pictures": "other_pictures", "logbook": "logbook", "log book": "logbook", "visual topo": "visual_topo"}
# Path parts and their link buckets, and survey file endings.
PATH_BUCKETS = {"/logbook/logbook-pdfs/": "logbook_pdf", "/history/scanned-pubs/": "scanned_pub", "/entpics/": "entrance_pics", "/ugpics/": "underground_pics", "/miscpics/": "misc_pics", "/rose-diags/": "rose_diagram", "/cantab/": "cantab", "/science/": "science", "/diving/": "diving", "/miscdocs/": "misc_doc", "/video/": "video_file", "/videos/": "video_file"}
SURVEY_ENDINGS = {".3d": "survey_3d", ".svx": "survey_3d", ".trox": "survey_3d", ".tro": "survey_3d", ".pdf": "survey_pdf", ".jpg": "survey_image", ".jpeg": "survey_image", ".gif": "survey_image", ".png": "survey_image", ".svg": "survey_image"}
BOILERPLATE = ("style-sheet.css", "sitecoordinatesaccuracy.pdf", "leaflet-latest.html", "logbook.php")
VIDEO_HOSTS = {"youtu.be", "www.youtube.com", "youtube.com", "vimeo.com"}
# Texts of the links that end the info line, where its boilerplate begins, and the dialogue's id.
TAIL_LINKS = ("area position", "site entrance in context", "logbook search")
BOILERPLATE_BEGINS = ("openmodal", "area position", "site entrance")
DIALOGUE = "openmodal"
# Tags whose closers may follow the info line.
HEADER_CLOSERS = {"small", "b", "i", "em", "p", "font", "a"}
# Traces of UTF-8 that was read as another encoding before.
MOJIBAKE = r"Ã[\x80-\xbf]|â€[\x80-\xbf\x99\x9c\x9d]?|Â[\xa0-\xbf]"
# Words of the header that no description holds, and marks of the speech widget.
HEADER_WORDS = ("Accuracy code", "Logbook search", "Area position")
SPEECH = ("data-speak", "text to speech", "reader.js")
# Where coordinates of the region lie, in metres.
EASTINGS, NORTHINGS = REGION = (400_000, 520_000), (4_750_000, 4_830_000)
# Formats of coordinates: zone, easting, northing; the old grid; a zone whose numbers are not known.
UTM = r"\b(\d{2}[A-Z])\s+(0?\d{6})\s+(\d{7})\b"
OLD_GRID = r"\bVN\s?([\d?]{4,8})\b"
NO_NUMBERS = r"\b(\d{2}[A-Z])\s+(?:\?{1,2}|0?\d*-)\s*(?:\?{1,2}|\d*-)?"
# What is said of a coordinate after it, and before it.
DATUM, ACCURACY, HEIGHT = r"\bDatum\s*:\s*([A-Za-z0-9]+)", r"\bAccuracy\s+code\s*:\s*([A-Z])\b", r"\bAlt(?:itude|\.)?\s*:?\s*c?\.?\s*(\d+(?:\.\d+)?)\s*m"
ENTRANCE = r"((?:[A-Z][A-Za-z]*\s+)?(?:entrances?|end)\b[^0-9]*?)(?:#(\d{4}))?\s*@?\s*$"
# Relations that a measurement in words states, first come first served, and formats of a system's name.
RELATIONS = (
    ("traverse_of", r"\btraverse\s+length\b"), ("part_of_system", r"\b(?:part|included)\s+(?:of|in|with)\s+(?:the\s+)?[\w\s]*?system\b"), ("part_of_system", r"\bSistema\b"), ("added_to", r"\badded\s+to\b"),
    ("included_in", r"\bincluded\b"), ("see_other", r"\bsee\b"),
)
SYSTEM = r"Sistema\s+de\s+(?:la\s+|los\s+|las\s+)?[A-Z][\w'’-]*(?:\s+[A-Z][\w'’-]*)*|(?:[A-Z][\w'’-]*\s+){1,3}System"
# Kinds of aliases, first come first served; a number of a site in an alias.
ALIASES = (("french_ref", r"\bFrench\s*:"), ("bare_number", r"^\d{1,4}$"), ("system_name", r"\b(?:Sistema|System)\b"), ("entrance_qualifier", r"\bentrances?\b"), ("spanish_alt", r"[^\W\d_]"))
# Author, year with a letter and a doubt, qualifier of a citation.
CITATION = r"(.+?)[,\s]\s*\(?\s*(1[6-9]\d{2}|20\d{2})([a-z])?\s*\)?\s*(\?)?\s*(?:\(([^)]*)\))?"

# Headings of descriptions and their canonical names.
CANONICAL = {
    "cave description": "description", "description": "description", "passage description": "description", "introduction": "introduction", "hydrology": "hydrology", "exploration history": "exploration_history",
    "history": "exploration_history", "bat information": "bat_information", "science": "science", "diving": "diving", "archaeology": "archaeology", "tackle requirements": "tackle", "conservation and restoration": "conservation",
}
# Seasons.
SEASONS = ("easter", "whit", "summer", "autumn", "spring", "winter", "christmas", "xmas", "new year")
# Words that announce the number of a site.
CUES = ("site", "sites", "shaft", "shafts", "cave", "caves", "dig", "digs", "hole", "holes", "cueva", "torca", "sima", "see")
# What a person does, names that are no persons, words that follow the name of a group.
DEEDS = ("dived", "surveyed", "explored", "descended", "pushed", "discovered", "bolted")
NO_PERSONS = {"la cambera", "el naso", "cueva hoyuca", "fuente aguanaz", "speleo club", "manchester university", "kendal caving", "cantabria government", "four valleys", "south vega", "north vega", "red pike", "bronze age", "birthday passage", "lake bassenthwaite", "cave diving", "sump index", "the team", "the entrance"}
GROUPS = ("group", "club", "team", "society", "expedition", "members", "cavers")
# Lengths of a heading, of a column's label, of a minimal description; the first year of the 1900s among two-digit years.
HEADING_CHARS, HEADING_WORDS, LABEL_CHARS, MINIMAL_CHARS, PIVOT = 60, 8, 40, 70, 50
# Emphasis that makes a heading, and the colour of editorial notes.
EMPHASIS, RED = ("b", "u", "strong", "big"), "ff0000"
# Formats of a name, of a batch, of a day, of a year.
NAME = r"[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+){1,2}"
BATCH, DAY, YEAR = r"\b(\d{4}[-_]\d{2}[-_]\d{2})\b", r"\b(\d{1,2})/(\d{1,2})/((?:19|20)?\d{2})\b", r"\b(19\d{2}|20[0-2]\d|2030)\b"
# Where a line of the bats' section begins, and its key and value.
BAT_LINE, BAT_PAIR = r"(?<=[a-z0-9)])\s(?=[A-Z][a-z]+\s*:)", r"\s*([A-Z][A-Za-z /()'-]{2,40})\s*:\s*(.+)$"
