"""Word lists, lookup tables and patterns that decide results."""

# Region codes in names -> full region, as written between parentheses.
REGION_CODES = {
    "U": "USA", "J": "Japan", "E": "Europe", "W": "World",
    "F": "France", "G": "Germany", "S": "Spain", "I": "Italy",
    "NL": "Netherlands", "SW": "Sweden", "A": "Australia",
    "K": "Korea", "B": "Brazil", "C": "China",
    "HK": "Hong Kong", "As": "Asia",
    "En": "En", "Ja": "Ja", "Fr": "Fr", "De": "De", "Es": "Es", "It": "It",
}

# Parenthesised remarks in a catalogue name that are not part of the collection name.
CATALOG_REMARKS = [
    "Parent-Clone", "Headerless", "Decrypted", "Encrypted", "BigEndian",
    "LittleEndian", "Multiboot", "Download Play", "PSN", "A2R",
]
CATALOG_STAMP = r"\d{8}-\d{6}"

# Leading words of a catalogue name that name its source, not a vendor.
SOURCE_PREFIXES = ["non-redump", "redump", "tosec", "nointro", "no-intro", "mame"]

# Words that do not count when collection names are compared word by word.
NOISE_WORDS = ["the", "of", "and", "for"]

# Known spellings of a collection; the first row that holds a spelling wins.
COLLECTION_ALIASES = {
    "nes": ["nintendo entertainment system", "famicom", "nes"],
    "snes": ["super nintendo entertainment system", "super famicom", "snes", "sfc", "super nes"],
    "n64": ["nintendo 64", "n64"],
    "gamecube": ["gamecube", "gcn", "ngc", "nintendo gamecube"],
    "wii": ["wii"],
    "wii u": ["wii u", "wiiu"],
    "switch": ["nintendo switch", "switch", "ns"],
    "3ds": ["nintendo 3ds", "3ds"],
    "ds": ["nintendo ds", "nds", "ds"],
    "gba": ["game boy advance", "gba"],
    "gbc": ["game boy color", "gbc"],
    "gb": ["game boy", "gb"],
    "genesis": ["mega drive", "genesis", "mega drive - genesis", "md", "gen"],
    "sega cd": ["sega cd", "mega cd", "scd", "megacd"],
    "32x": ["sega 32x", "32x"],
    "saturn": ["saturn", "sega saturn", "sat"],
    "dreamcast": ["dreamcast", "dc"],
    "gg": ["game gear", "gg"],
    "sms": ["master system", "sms"],
    "ps1": ["playstation", "ps1", "psx", "ps one", "ps one classics"],
    "ps2": ["playstation 2", "ps2"],
    "ps3": ["playstation 3", "ps3"],
    "ps4": ["playstation 4", "ps4"],
    "ps5": ["playstation 5", "ps5"],
    "psp": ["playstation portable", "psp"],
    "vita": ["playstation vita", "vita", "psv", "ps vita"],
    "xbox": ["xbox", "microsoft xbox"],
    "xbox 360": ["xbox 360", "x360"],
    "xbox one": ["xbox one", "xone"],
    "xbox series": ["xbox series x", "xbox series s", "xbox series x/s", "xsx", "xss", "xs"],
    "pce": ["pc engine", "turbografx-16", "turbografx 16", "tg16", "pce"],
    "neo geo aes": ["neo geo aes", "neo-geo aes", "aes", "neoaes"],
    "neo geo cd": ["neo geo cd", "neo-geo cd", "neocd"],
    "neo geo pocket": ["neogeo pocket", "neo geo pocket", "ngp", "ngpc", "neo geo pocket color"],
    "neo geo": ["neogeo", "neo geo", "neo-geo"],
    "atari 2600": ["atari 2600", "2600", "a2600", "vcs"],
    "atari 5200": ["atari 5200", "5200", "a5200"],
    "atari 7800": ["atari 7800", "7800", "a7800"],
    "atari jaguar": ["atari jaguar", "jaguar", "jag"],
    "atari lynx": ["atari lynx", "lynx"],
    "intellivision": ["intellivision", "intv"],
    "colecovision": ["colecovision", "coleco", "col"],
    "odyssey2": ["odyssey 2", "odyssey²", "videopac", "ody2", "o2", "vp"],
    "c64": ["commodore 64", "c64", "64"],
    "msx2+": ["msx2+", "msx2 plus"],
    "wsc": ["wonderswan color", "wsc"],
}

# Accepted member types per collection (substring of its name); order matters.
MEMBER_TYPES = {
    "Nintendo 64": [".z64", ".v64", ".n64"],
    "Super Nintendo": [".sfc", ".smc", ".swc", ".fig"],
    "Nintendo Entertainment System": [".nes", ".unf", ".unif"],
    "Famicom Disk System": [".fds"],
    "Game Boy Advance": [".gba"],
    "Game Boy Color": [".gbc"],
    "Game Boy": [".gb"],
    "Nintendo DS": [".nds"],
    "Nintendo 3DS": [".3ds", ".cia"],
    "Mega Drive": [".md", ".smd", ".bin", ".gen"],
    "Genesis": [".md", ".smd", ".bin", ".gen"],
    "Master System": [".sms"],
    "Game Gear": [".gg"],
    "Saturn": [".bin", ".iso", ".img", ".chd", ".cue"],
    "Dreamcast": [".bin", ".iso", ".chd", ".cdi", ".gdi"],
    "PlayStation": [".bin", ".iso", ".img", ".chd", ".cue"],
    "PlayStation 2": [".iso", ".chd", ".bin", ".cue", ".cso", ".zso", ".gz"],
    "PlayStation Portable": [".iso", ".cso", ".chd"],
    "PC Engine": [".pce", ".bin"],
    "TurboGrafx": [".pce", ".bin"],
    "Neo Geo": [".neo"],
    "Neo Geo Pocket": [".ngp", ".ngc"],
    "WonderSwan": [".ws", ".wsc"],
    "Atari 2600": [".a26", ".bin"],
    "Atari 5200": [".a52", ".bin"],
    "Atari 7800": [".a78", ".bin"],
    "Atari Lynx": [".lnx"],
    "Atari Jaguar": [".j64", ".jag", ".bin"],
    "32X": [".32x", ".bin"],
    "Sega CD": [".bin", ".iso", ".chd"],
    "Virtual Boy": [".vb"],
}

# Member types listed first in the member table of an archive.
PRIMARY_TYPES = [
    "z64", "v64", "n64", "sfc", "smc", "nes", "gba", "gbc", "gb",
    "md", "smd", "bin", "iso", "chd", "cue", "img", "cdi",
]

# Prefix lengths tried in front of the content, with the words used in reasons.
PREFIXES = [
    (512, "SMC/SWC copier header (SNES)"),
    (16, "iNES header (NES)"),
    (64, "Lynx header"),
    (8192, "Atari 7800 header"),
]
# File types that never carry such a prefix.
NO_PREFIX_TYPES = [".7z", ".iso", ".chd", ".cso", ".zso", ".gz", ".cue"]
# Prefix length a plan strips, by member type.
PREFIX_BY_TYPE = {".smc": 512, ".swc": 512, ".fig": 512, ".nes": 16}

# First two content bytes (hex) -> byte order.
BYTE_ORDER_MAGIC = {"8037": "bigendian", "3780": "byteswapped", "4012": "littleendian"}
BYTE_ORDER_LABELS = {
    "bigendian": "Big Endian (.z64)",
    "byteswapped": "Byte Swapped (.v64) — every byte pair swapped",
    "littleendian": "Little Endian (.n64) — every 4-byte group reversed",
}
BYTE_ORDER_BY_TYPE = {".z64": "bigendian", ".v64": "byteswapped", ".n64": "littleendian"}
# Catalogues (substring of the name) whose files are also tried in the other byte orders.
BYTE_ORDER_CATALOGS = ["Nintendo 64"]

# Disc image header: tag, version, and where its digest lies.
DISC_TAG = b"MComprHD"
DISC_VERSION = 5

# Plan rules per collection (substring of its name, longest wins).
DEFAULT_RULES = ["strip_header", "rename_ext", "remove_embedded", "compress_package"]
PLAN_RULES = {
    "Nintendo 64": ["strip_header", "rename_ext", "remove_embedded", "compress_package", "convert_byteorder"],
    "N64": ["strip_header", "rename_ext", "remove_embedded", "compress_package", "convert_byteorder"],
    "PlayStation 2": ["remove_embedded", "loose_file"],
    "PS2": ["remove_embedded", "loose_file"],
    "PlayStation Portable": ["remove_embedded", "loose_file"],
    "PSP": ["remove_embedded", "loose_file"],
    "PlayStation": ["loose_file"],
    "PS1": ["loose_file"],
    "PSX": ["loose_file"],
    "Dreamcast": ["loose_file"],
    "Saturn": ["loose_file"],
    "Sega CD": ["loose_file"],
}

# Type groups of the compatibility rating.
DISC_FILE_TYPES = [".chd", ".iso", ".cue", ".bin", ".cdi", ".cso"]
DISC_ENTRY_TYPES = [".chd", ".iso", ".cue", ".bin", ".img"]
STORE_ENTRY_TYPES = [".pkg", ".rap"]
ARCHIVE_TYPES = [".zip", ".7z"]

# Statuses shown by default, and after an analysis.
DEFAULT_VIEW = ["ok", "unverified", "unmatched", "matched"]
FOCUS_VIEW = ["ok", "unverified", "unmatched", "matched", "duplicate"]
