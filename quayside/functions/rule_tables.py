"""Default rule tables. All patterns and names here are fixed values that results depend on."""

from __future__ import annotations

from quayside.functions.rules import RuleSet

SEARCH_SIGNAL = (
    r"(\bsearch(?:es|ing|ed)?\b|\bsearch (?:bar|box|button|function|result|filter|page)\b|\b(?:face|people|keyword|text|video|photo|image) search\b"
    r"|\b(?:can't|cannot|couldn't|could not|won't|will not|doesn't|does not) find\b"
    r"|\bfind(?:ing)? (?:my |the )?(?:photos?|pictures?|videos?|images?|screenshots?|albums?)\b"
    r"|\b(?:look(?:ing)?|looked) for (?:a |my |the )?(?:photos?|pictures?|videos?|images?)\b"
    r"|\bmore like this\b|\bgrouped by date\b|\bdate grouping\b|\bface group(?:ing)?\b|\bpeople album\b|\brecogni[sz]e\b|\bobject recognition\b)"
)
THEMES_OUTSIDE = RuleSet((
    ("editing", r"\b(magic eraser|photo editor|editing tools|edit(?:ing)? tools|crop photos|export frame|highlight which is getting processed|creations module|saving after editing)\b"),
    ("privacy", r"\b(privacy invasive|without my consent|full access to every photo|give (?:google )?access to every photo|photo.?access permission|animated [\"']?shimmer[\"']?|scanning my photos without)\b"),
    ("sharing", r"\b(accidentally shared|undo this\b.*\bshar|partner sharing|shared library|shared albums?|share (?:a )?link|contribute to album|choose from (?:fb|facebook|whatsapp)|can't find the edited ones)\b"),
    ("backup", r"\b(backup|back up|sync(?:ing)?|storage quota|upload only|recycle bin|permanently deleted|restore deleted|recover (?:my )?(?:deleted|permanently)|from (?:the )?trash|from (?:the )?bin|switched (?:to a )?new phone|device (?:change|migration)|move photos from my google photos|not syncing|storage full|keep all my photos on my device)\b"),
    ("layout", r"\b(edit button is at the bottom|custom ordering in albums|ordering of photos in albums|print photos|chromecast|download the photo is broken|menu to share or download)\b"),
    ("defect", r"\b(creations module|stuck processing|wifi and internet connection is stable|audio destination from videos)\b"),
    ("restore", r"\b(restore|recover|recycle bin|permanently deleted|deleted (?:photos?|data|videos?)|(?:photos?|videos?|data)(?:\s+\w+){0,3}\s+deleted|photos? in trash|from (?:the )?trash|from (?:the )?bin|locked folder)\b"),
))
#: Themes that stay outside unless what is beside them hits.
THEMES_UNLESS = (
    ("restore", r"\bsearch\b"),
    ("privacy", r"\bsearch\b|\bfind (?:my |the )?(?:photos?|pictures?)\b"),
    ("editing", r"\bsearch\b"),
    ("backup", r"\bsearch\b|\bface (?:search|group)|can't find (?:my )?(?:photos?|pictures?)"),
)
MENU_TROUBLE = r"can't find it in the (?:three dot|menu)|find the edit button"
UNDECIDED = r"\b(search settings|people to share|share with)\b"

FIRST_LABELS = RuleSet((
    ("deleted_locked_partner_sharing", r"\b(in trash|were deleted|locked folder|partner sharing|shared library|locked album)\b"),
    ("backup_sync_storage", r"\b(backup|sync|storage quota|upload|switched phones|device change)\b"),
    ("query_failure_complete_info", r"\b(exact date|exact day|searched the exact|right album name)\b"),
    ("workarounds_succeeded", r"\b(years view|workaround (actually )?worked|partner'?s phone|found it by browsing)\b"),
    ("search_abandonment", r"\b(gave up|two or three times|tried search three times|abandon)\b"),
    ("metadata_gaps", r"\b(dates? (are|is) (all )?wrong|people tags?|metadata)\b"),
    ("library_scale_recency", r"\b(thousands of photos|3000|3,000|old pictures from years)\b"),
    ("incomplete_memory_object_time", r"\b(screenshot|warranty card|last autumn|months ago|medicine)\b"),
    ("incomplete_memory_person_occasion", r"\b(cousin|brother|sister|which summer|which holiday)\b"),
    ("incomplete_memory_place_event", r"\b(night market|city walk|without remembering the date|lakeside cabin)\b"),
    ("query_formulation_mismatch", r"\b(wrong keyword|keyword mismatch)\b"),
))
PAIN_POINTS = RuleSet((
    ("design_missing_search_control", r"(\b(?:where (?:is|did) (?:the )?|where's (?:the )?)(?:search (?:button|bar|icon|tab|function)|more like this)\b|\b(?:search (?:button|bar|icon|tab)|more like this)\b.{0,40}\b(?:is gone|went away|missing|nowhere to be found|removed|moved|disappeared)\b|\b(?:took|taken|removed|moved) (?:the |away the )?(?:old )?search (?:button|bar|icon|tab)\b|\b(?:give|bring) back (?:the |my )?(?:old )?search (?:button|bar|icon|tab)\b)"),
    ("design_date_grouping", r"\b(date grouping|grouped by date|monthly sections|photos being grouped by date|dates disappeared)\b"),
    ("design_prefer_previous_ui", r"\b(used to (?:be able|work)|like it used to|old (?:search|method|layout|ui)|before (?:the )?(?:recent )?update|bring back the (?:old|previous)|prefer (?:the )?(?:old|previous)|doesn't work like it used to)\b"),
    ("design_ui_navigation", r"\b(hard(?:er)? to (?:find|navigate|organise|organize|view)|cluttered together|all mixed together|where did it go|can't find it anywhere|layout (?:update|change)|new layout)\b"),
    ("system_face_grouping", r"\b(face (?:search|group|grouping|album)|people album|not detecting faces|won't acknowledge faces|separate people into two|two different profiles|unrecognized people|manually tag|doesn't recognize (?:that )?there is one)\b"),
    ("system_metadata_gaps", r"\b(file name|filename|wrong date|creation date|metadata|specific location|custom radius|place|date/time|incorrect (?:date|time|location)|by their locations)\b"),
    ("system_object_recognition", r"\b(object recognition|search (?:for )?(?:objects?|colors?|words)|text (?:search )?in photos|search text in|what they contain|what the photo (?:had|contains))\b"),
    ("system_search_bugs", r"\b((?:search|app).{0,30}\b(crash|crashes|freeze|hangs|locks? up|glitch|bug)|(?:crash|crashes|freeze|hangs|locks? up).{0,30}\bsearch)\b"),
    ("system_other_failures", r"\b(can't find|cannot find|couldn't find|doesn't find|does not find|will not find|search (?:is )?(?:broken|broke|useless|doesn't work|does not work)|similar photos|cropped one)\b"),
    ("query_followup_ignored", r"\b(follow.?up query|follow up query|ignores? the initial|completely ignore the initial)\b"),
    ("query_not_understood", r"\b(nerf the search|can't find the search your looking|doesn't understand|does not understand|search (?:feature )?failing to understand|ai has made this useless)\b"),
    ("knowledge_unknown_capability", r"\b(didn't know|did not know|til\b|i just happened to|didn't realise|did not realize|had no idea|can you search|is there a way to (?:search|find)|hidden search|how (?:do|can) i search|is there any ways? to do that)\b"),
))
PARENTS = {
    "design_ui_navigation": "design_issues", "design_prefer_previous_ui": "design_issues", "design_missing_search_control": "design_issues", "design_date_grouping": "design_issues",
    "system_face_grouping": "system_issues", "system_metadata_gaps": "system_issues", "system_object_recognition": "system_issues", "system_other_failures": "system_issues", "system_search_bugs": "system_issues",
    "query_not_understood": "query_inference", "query_followup_ignored": "query_inference", "knowledge_unknown_capability": "knowledge_awareness_gaps",
}
ALIASES = {"knowledge_hidden_features": "knowledge_unknown_capability"}
SEARCH_TYPES = RuleSet((
    ("search_ai_search", r"\b(search bar|search function|search feature|search option|search results|ai search|ask photos|gemini)\b"),
    ("people_pets", r"\b(face(?:s| grouping| group| search| album)?|people search|people album|pet(?:s)?|dog|cat|person|people|who is in|label(?:ed)? faces|unrecognized people)\b"),
    ("places", r"\b(location|map view|places?|where (?:it|i|we) (?:took|was)|custom radius|photos (?:i )?took at|search .{0,24}location|by (?:their )?locations?)\b"),
    ("date_time", r"\b(date grouping|grouped by date|monthly sections|year(?:s)? view|specific years?|chronological|by date|creation date|wrong date|last (?:year|month|week|autumn)|from 20\d{2})\b"),
    ("objects", r"\b(objects?|colors?|what they contain|what the photo had|text (?:in|on) (?:the )?photos?|ocr|bees|screenshot of the photo|similar photos|more like this)\b"),
    ("events", r"\b(event(?:s)?|holiday|birthday|wedding|trip|vacation|search .{0,20}event)\b"),
    ("file_type", r"\b(videos?|screenshots?|selfies?|live photos?|filter to search only|search only for (?:photos?|videos?))\b"),
    ("albums", r"\b(albums?|collections?|people album)\b"),
    ("memories", r"\b(memor(?:y|ies)|memories reels|on this day)\b"),
    ("other", r"\b(on device|on-device|camera folder|photos on device vs|filename|file name|recently added)\b"),
))
FORUM_SOLUTION = r"(\b(?:try|have you tried|you can|you should|just go to|go to the|workaround|good luck|doesn't sound|does not sound|as others (?:have )?said|that should give you|do one of these|i would recommend)\b|\btry (?:to )?search\b)"
OWN_PAIN = r"\b(i (?:can't|cannot|couldn't|tried|hate|wish|need)|my (?:photos?|search|app|library)|search (?:doesn't|does not|won't|is broken))\b"
OVERALL_ONLY = r"^\s*(?:i )?(?:can't|cannot|couldn't) (?:ever )?find my (?:pictures|photos)!?\s*$"
SUGGESTION = r"\b(please (?:add|bring|fix|restore)|should add|would (?:be nice|love if)|feature request|bring back|at least give|why (?:don't|isn't|is there no)|i wish|it would be great if|update it like)\b"
SEARCHISH = r"\b(search|find (?:photos?|pictures?|videos?)|face|people album|date grouping)\b"
QUESTION_ONLY = r"^\s*(?:how (?:do|can|to)|is there a way|can you|where is|where's)\b"
PAIN = (
    r"\b(can't find|cannot find|couldn't find|doesn't find|does not find|doesn't work|does not work|not working|wrong results|missing|gone|disappeared|nerf|ignored|how (?:do|can|to) (?:i )?search|is there a way|face (?:search|group|grouping)"
    r"|people album|separate people|inconsistent|won't acknowledge|unrecognized people|date grouping|search bar|search button|search function|filename|file name|metadata|wrong date|more like this|didn't know|did not know|til\b|follow.?up query)"
)
NOT_SEARCH_SUGGESTION, SEARCH_SUGGESTION = r"\b(backup|storage quota|widget control)\b", r"\b(search bar|search function|search by|face grouping|date grouping)\b"
POSITIVE_OUTCOMES = (
    r"\b((?:can|could|able to|always) find|found (?:the |my |those )?(?:photo|picture|image|it)|find photos of specific|surfaces? photos|search (?:is )?(?:unbeatable|excellent|incredible|perfect|amazing))\b",
    r"\b((?:relevant|accurate) results|improvements? you did to search|search mostly (?:works|returns)|now you surface)\b",
    r"\b(search (?:is |was )?(?:intuitive|fast|easy|simple)|easy to find|search your photos with an ease|love the (?:search|memories))\b",
)
NEGATIVE_OUTCOMES = (
    r"\b((?:can't|cannot|couldn't|could not|won't) find|unable to find|doesn't find|does not find|never finds|search (?:is )?(?:broken|broke|useless|horrible|awful)|search (?:often |still )?(?:doesn't|does not|won't|will not) work|search no longer works|search function gone)\b",
    r"\b((?:wrong|irrelevant|inaccurate|nonsensical|incomplete) results|search (?:w/ |with )?wrong results|hundreds of images to scroll|random photo from my library)\b",
    r"\b((?:unintuitive|slow|difficult|hard|impossible) to (?:find|search|use)|photos are so hard to find|much harder to (?:organise|organize|view|find)|practically impossible|requir(?:es|ing) excessive effort)\b",
)
POSITIVE_TONE = r"\b(love|great|awesome|excellent|amazing|fantastic|perfect|impressed|thankful)\b"
NEGATIVE_TONE = r"\b(hate|terrible|awful|horrible|useless|worst|broken|frustrat|disappoint|garbage|sucks|ridiculous)\b"
LARGE_LIBRARY = r"\b(3000\+?|3,000|thousands? of photos|huge library|tens of thousands|large library)\b"
YEARS_OLD = r"\b(years? ago|last year|old photos?|old pictures?|decade|from 20\d{2})\b"
RECENT = r"\b(yesterday|last week|last month|this week|recent(ly)?)\b"
DEVICE = r"\b(iphone|ipad|ios|android|pixel|samsung|oneplus|xiaomi|huawei|mac|windows phone)\b"
DEVICE_FAMILY = {"iphone": "ios", "ipad": "ios", "ios": "ios", "mac": "ios", "android": "android", "pixel": "android", "samsung": "android", "oneplus": "android", "xiaomi": "android", "huawei": "android"}
COUNTRY = r"\b(united states|usa|uk|united kingdom|canada|australia|germany|france|india|japan|brazil|mexico|spain|italy|netherlands|sweden|ireland|new zealand|singapore|indonesia|philippines)\b"
FRUSTRATION = r"\b(can't find|cannot find|couldn't find|useless|hate|frustrated|give up|gave up|impossible|never (finds|works)|broken|worst|terrible|angry)\b"
EMOTION = r"\b(family|wedding|travel|memory|memories|sick|medicine|baby|funeral|anniversary|holiday|cousin|brother|sister|child)\b"
SUPPORTING_NODES = ("incomplete_memory", "incomplete_memory_place_event", "incomplete_memory_person_occasion", "incomplete_memory_object_time", "query_inference", "query_not_understood", "query_followup_ignored", "knowledge_awareness_gaps", "knowledge_unknown_capability")
CONTRADICTING_NODES = ("backup_sync_storage", "deleted_locked_partner_sharing", "query_failure_complete_info", "system_issues", "system_face_grouping", "system_metadata_gaps", "system_object_recognition", "system_other_failures", "system_search_bugs")
SOURCES = ("app_store", "play_store", "reddit", "help_community")
REDACTED_KEYS = ("author", "author_name", "authorname", "username", "user", "display_name", "displayname", "author_handle", "authorhandle", "im:name", "reviewer")

# What is asked of a search: fixed values.
QUERY_OUTSIDE = (
    r"\b(train(?:ing)?\s+(?:the\s+)?model|fine[- ]?tune|write\s+(?:a\s+)?python|python\s+scraper|scrape\s+(?:the\s+)?play\s+store|what\s+is\s+rag\b|how\s+does\s+(?:this|the)\s+(?:discovery|research)\s+engine\s+work"
    r"|discovery\s+engine\s+work|capital\s+of\s+france|who\s+won\s+the\s+world\s+cup|openai|chatgpt|gemini\s+api)\b"
)
QUERY_PRODUCT = r"\b(google\s+photos|gphotos|photos\s+app)\b"
QUERY_RETRIEVAL = r"\b(find|search|locate|look(?:ing)?\s+for|can't\s+find|cannot\s+find|couldn't\s+find|old\s+pictures?|old\s+photos?|screenshot|metadata|people|face|album|remember\s+when|incomplete\s+memory|workaround|date|location|place|years?\s+ago|abandon|gave\s+up|scroll)\b"
QUERY_STORAGE = r"\b(backup|sync|storage|quota|billing|subscription|payment|upload)\b"
QUERY_FINDING = r"\b(find|search|locate|missing\s+photo|can't\s+find|cannot\s+find)\b"
QUERY_REVIEW = r"\b(pain\s+points?|sentiment|themes?|frustrations?|complaints?|key\s+findings?|what\s+are|how\s+(?:is|are|do)\s+users?|overall|search\s+experience|user\s+feedback|evidence)\b"
QUERY_SUBJECT = r"\b(search|photos?|retrieval|feedback|google\s+photos|users?|ask\s+photos|ai\s+search)\b"

# The help forum's page around a thread: fixed values.
HELP_TITLE_SUFFIX = r"\s*-\s*Google Photos Community\s*$"
HELP_TITLE_MARK = r"\s*-?\s*Google Photos Community"
HELP_CHROME = (
    r"(Skip to main content|Google Photos Help|Sign in|Google Help|Help Center(?: experience)?|Community Policy|Community Overview|Privacy Policy|Terms of Service|Submit feedback|Send feedback(?: about our Help Center)?"
    r"|This help content & information|General Help Center experience|Enable Dark Mode|Google apps|Main menu|Clear search|Close search|Search Help Center|Can't find your photos\?|Notification|Community Google Photos on(?:\.{2,}|…)"
    r"|Passkeys are the simplest and most secure way to sign in to your account\.[^.]*\.|To sign in with just your fingerprint[^.]+\.|©\s*20\d{2}\s*Google|false|true|Close Next|Next Help Center Community)"
)
HELP_NAVIGATION = r"\bSearch\b(?:\s+\d+)?"
HELP_NOISE = r"\b(\d{6,}|(?:true|false))\b"
#: Words that a static search leaves out of a query: fixed values.
STOP_WORDS = (
    "the", "and", "for", "are", "what", "how", "with", "this", "that", "from", "about",
    "around", "users", "user", "google", "photos", "photo", "search", "into", "does", "have",
)
