"""Word lists, key tables, headers and limits that results depend on."""

# --- fixed values -----------------------------------------------------------

CATEGORIES = [
    "Action", "Adventure", "Arcade", "Board", "Card", "Casino", "Casual", "Educational",
    "Music", "Puzzle", "Racing", "Role_Playing", "Simulation", "Sports", "Strategy",
    "Trivia", "Word",
]

PUNCTUATION = ":/\\,.[]}{()*-_$\"'+?:@#^&!="
MAX_TEXT = 3000
MIN_TEXT = 800
HOLD_OUT = 20
NAME_REPEATS = 5

APP_HEADER = [
    "Category", "Package", "Name", "Updated", "Size", "Installs", "Requires_Android",
    "Age", "Developer", "Rating", "Rating_Total", "Rating_5", "Rating_4", "Rating_3",
    "Rating_2", "Rating_1", "Price", "Description", "Content_Feature", "Permission",
    "Inapp_Products", "Version",
]
TRIVIAL_FIELDS = ["Inapp_Products", "Permission"]
TRIVIAL_DEFAULT = "???"
MIN_FIELDS = 10

SECTION_KEYS = {
    "Category": "Category",
    "Package": "Package",
    "Age": "Age",
    "Developer": "Developer",
    "Download": "Installs",
    "Edition": "Version",
    "System": "Requires_Android",
    "Rating": "Rating",
    "Rating_Num": "Rating_Total",
    "1-Star_Rating_Num": "Rating_1",
    "2-Star_Rating_Num": "Rating_2",
    "3-Star_Rating_Num": "Rating_3",
    "4-Star_Rating_Num": "Rating_4",
    "5-Star_Rating_Num": "Rating_5",
    "Name": "Name",
    "Update_Time": "Updated",
    "Price": "Price",
    "Permission": "Permission",
    "Description": "Description",
}

CONTENT_PHRASES = {
    "Alcohol Reference": ["Alcohol"],
    "Alcohol and Tobacco Reference": ["Alcohol", "Tobacco"],
    "Blood": ["Blood"],
    "Blood and Gore": ["Blood"],
    "Cartoon Violence": ["Cartoon_Violence"],
    "Comic Mischief": ["Mischief"],
    "Crude Humor": ["Crude_Humor"],
    "Diverse Content: Discretion Advised": ["Discretion_Advised"],
    "Drug Reference": ["Drug"],
    "Drug and Alcohol Reference": ["Alcohol", "Drug"],
    "Extreme Violence": ["Extreme_Violence"],
    "Fantasy Violence": ["Cartoon_Violence"],
    "Fear": ["Horror"],
    "Gambling": ["Gambling"],
    "Horror": ["Horror"],
    "Implied Violence": ["Implied_Violence"],
    "Intense Violence": ["Extreme_Violence"],
    "Language": ["Language"],
    "Learn More": ["Unrated"],
    "Mild Blood": ["Mild_Blood"],
    "Mild Fantasy Violence": ["Mild_Violence"],
    "Mild Language": ["Language"],
    "Mild Swearing": ["Language"],
    "Mild Violence": ["Mild_Violence"],
    "Moderate Violence": ["Mild_Violence"],
    "Nudity": ["Sexual"],
    "Partial Nudity": ["Sexual"],
    "Sexual Content": ["Sexual"],
    "Sexual Innuendo": ["Sexual"],
    "Sexual Themes": ["Sexual"],
    "Simulated Gambling": ["Gambling"],
    "Strong Language": ["Language"],
    "Strong Sexual Content": ["Sexual"],
    "Strong Violence": ["Extreme_Violence"],
    "Suggestive Themes": ["Suggestive_Themes"],
    "Tobacco Reference": ["Tobacco"],
    "Use of Alcohol": ["Alcohol"],
    "Use of Alcohol and Tobacco": ["Alcohol", "Tobacco"],
    "Use of Alcohol/Tobacco": ["Alcohol", "Tobacco"],
    "Use of Drugs": ["Drug"],
    "Use of Drugs and Alcohol": ["Drug", "Alcohol"],
    "Use of Tobacco": ["Tobacco"],
    "Violence": ["Violence"],
    "Violent References": ["Violence"],
    "Warning – content has not yet been rated. Unrated apps may potentially contain "
    "content appropriate for mature audiences only.": ["Unrated"],
}

CONTENT_KEYS = [
    "Alcohol", "Blood", "Cartoon_Violence", "Crude_Humor", "Discretion_Advised", "Drug",
    "Extreme_Violence", "Gambling", "Horror", "Implied_Violence", "Language", "Mild_Blood",
    "Mild_Violence", "Mischief", "Sexual", "Suggestive_Themes", "Tobacco", "Unrated",
    "Violence",
]

PERMISSION_KEYS = [
    "Google Play license check", "access Bluetooth settings",
    "access USB storage filesystem", "approximate location (network-based)",
    "change network connectivity", "change your audio settings",
    "connect and disconnect from Wi-Fi", "control vibration", "disable your screen lock",
    "draw over other apps", "find accounts on the device", "install shortcuts",
    "modify or delete the contents of your USB storage", "modify system settings",
    "pair with Bluetooth devices", "precise location (GPS and network-based)",
    "prevent device from sleeping", "read Google service configuration",
    "read phone status and identity", "read the contents of your USB storage",
    "receive data from Internet", "record audio", "retrieve running apps",
    "run at startup", "take pictures and videos", "use accounts on the device",
    "view Wi-Fi connections", "view network connections",
]

AGE_RANKS = {
    "Everyone": 0,
    "Everyone 10+": 3,
    "Mature 17+": 7,
    "Rated for 12+": 4,
    "Rated for 16+": 6,
    "Rated for 18+": 8,
    "Rated for 3+": 1,
    "Rated for 7+": 2,
    "Teen": 5,
    "Unrated": 0,
}

# Ids kept whatever their text length and always part of a balanced sample.
IMPORTANT_IDS = [
    "com.yodo1.rodeo.safari", "com.ubisoft.hungrysharkworld", "com.devolver.downwell",
    "com.nianticlabs.pokemongo", "com.eline.neveralonemobile", "com.turbochilli.rollingsky",
    "com.blizzard.wtcg.hearthstone", "com.devolver.reigns", "com.outerminds.tubular",
    "com.Seriously.Forever", "com.Zeeppo.GuitarBand", "com.youmusic.magictiles",
    "com.gismart.realpianofree", "game.puzzle.blockpuzzle", "com.protey.doors_challenge2",
    "game2048.b2048game.twozerofoureight2048.game", "com.FireproofStudios.TheRoom3",
    "com.martinmagni.mekorama", "com.combineinc.streetracing.driftthreeD",
    "com.silevel.mountainclimbstunt", "com.wordsmobile.RealBikeRacing",
    "role-com.nexon.hit.global", "com.springloaded.thelastvikings",
    "com.ea.game.starwarscapital_row", "com.scopely.headshot",
    "com.kongregate.mobile.thetrail.google", "com.ea.gp.nbamobile",
    "com.supercell.clashroyale&uo=4&ct=appcards", "com.epicwaronline.ms",
    "com.igg.android.lordsmobile", "com.tencent.ig", "com.netease.ko",
    "com.robtopx.geometryjumplite", "com.robtopx.geometryjump", "com.ea.game.pvzfree_row",
    "com.zeptolab.ctr.ads", "com.mojang.minecraftpe", "com.ngame.allstar.eu",
    "com.cmplay.dancingline", "com.rovio.angrybirds", "com.mobile.legends",
    "com.ustwo.monumentvalley", "com.tomorrowcorporation.humanresourcemachine",
]

SEED_IDS = [
    "com.orangeapps.piratetreasure", "se.hellothere.gravityhd",
    "com.makingfun.mageandminions", "com.gameloft.android.ANMP.Gloft5DHM",
    "com.Zeeppo.GuitarBand",
]

MODEL_ORDER = ["naive", "well", "linear_well", "kfold_well", "nbsvm", "spysvm", "iterspysvm"]

WORD_PATTERN = r"(?U)\b\w\w+\b"
BLANK_WORD_PATTERN = r"(?U)\b\w\w +\b"

NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
