"""Places named in a short text: foreign countries, regions and cities, and the United States, from a bounded gazetteer.

A text falls into segments, and each is read alone. Of overlapping names the longest counts. A state that is
called like a country, or a state behind a place that is, makes the place American; a foreign country makes the
American names beside it foreign.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import let

# Names of places.
COUNTRIES = (
    "Costa Rica|United Kingdom|Canada|India|Brazil|Germany|France|Mexico|Australia|Philippines|Japan|Singapore|Poland|Ireland|Netherlands|Spain|Portugal|South Africa|New Zealand|Argentina|Colombia|"
    "Romania|Switzerland|South Korea|North Korea|Taiwan|Hong Kong|China|Israel|Ukraine|Italy|Peru|Chile|Uruguay|Ecuador|Venezuela|Bolivia|Paraguay|Panama|Guatemala|El Salvador|Honduras|Nicaragua|"
    "Dominican Republic|Jamaica|Trinidad and Tobago|Bahamas|Barbados|Belgium|Austria|Czech Republic|Slovakia|Slovenia|Croatia|Serbia|Bosnia and Herzegovina|Montenegro|North Macedonia|Albania|Greece|"
    "Cyprus|Malta|Hungary|Bulgaria|Moldova|Lithuania|Latvia|Estonia|Finland|Sweden|Norway|Denmark|Iceland|Luxembourg|Monaco|Liechtenstein|Turkey|Russia|Belarus|Armenia|Azerbaijan|Kazakhstan|Uzbekistan|"
    "Kyrgyzstan|Pakistan|Bangladesh|Sri Lanka|Nepal|Bhutan|Indonesia|Malaysia|Thailand|Vietnam|Cambodia|Laos|Myanmar|Mongolia|United Arab Emirates|Saudi Arabia|Qatar|Bahrain|Kuwait|Oman|Jordan|Lebanon|"
    "Egypt|Morocco|Tunisia|Algeria|Nigeria|Kenya|Ghana|Uganda|Tanzania|Rwanda|Ethiopia|Senegal|Zambia|Zimbabwe|Mauritius|Botswana|Namibia|Mozambique|Angola|Cameroon|Madagascar|Fiji|Papua New Guinea"
).split("|")
COUNTRY_ALIASES = {
    "UK": "United Kingdom", "U.K.": "United Kingdom", "England": "United Kingdom", "Scotland": "United Kingdom", "Wales": "United Kingdom", "Northern Ireland": "United Kingdom",
    "Czechia": "Czech Republic", "Türkiye": "Turkey", "UAE": "United Arab Emirates", "Viet Nam": "Vietnam",
}
ISO_COUNTRIES = {
    "GB": "United Kingdom", "CA": "Canada", "IN": "India", "BR": "Brazil", "DE": "Germany", "FR": "France", "MX": "Mexico", "AU": "Australia", "PH": "Philippines", "JP": "Japan", "SG": "Singapore",
    "PL": "Poland", "IE": "Ireland", "NL": "Netherlands", "ES": "Spain", "PT": "Portugal", "ZA": "South Africa", "NZ": "New Zealand", "AR": "Argentina", "CO": "Colombia", "RO": "Romania",
    "CH": "Switzerland", "KR": "South Korea", "TW": "Taiwan", "HK": "Hong Kong", "CN": "China", "IL": "Israel", "UA": "Ukraine", "IT": "Italy", "PE": "Peru", "CL": "Chile", "CR": "Costa Rica",
    "AE": "United Arab Emirates", "SE": "Sweden", "DK": "Denmark", "FI": "Finland", "NO": "Norway", "BE": "Belgium", "AT": "Austria", "CZ": "Czech Republic", "MY": "Malaysia", "TH": "Thailand",
    "VN": "Vietnam", "ID": "Indonesia", "PK": "Pakistan", "NG": "Nigeria", "KE": "Kenya",
}
REGIONS = "EMEA|APAC|APJ|EU|Europe|European Union|LATAM|Latin America|Asia Pacific|Asia-Pacific|Asia|Africa|Middle East|DACH|ANZ".split("|")
STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|"
    "Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|"
    "Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia"
).split("|")
STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
US_CITIES = (
    "New York|New York City|NYC|San Francisco|Los Angeles|San Diego|San Jose|Seattle|Boston|Austin|Dallas|Houston|Chicago|Denver|Atlanta|Miami|Philadelphia|Phoenix|Salt Lake City|Mountain View|Palo Alto|"
    "Sunnyvale|Santa Clara|San Mateo|Redwood City|Menlo Park|Bellevue|San Antonio|Raleigh|Charlotte|Minneapolis|Pittsburgh|Detroit|Indianapolis|Nashville|Tampa|Orlando|Las Vegas|Reno|Baltimore|Cincinnati|"
    "Kansas City|Boulder|Sacramento|Irvine|Santa Monica"
).split("|")
CITIES = {
    "United Kingdom": "London|Manchester|Bristol|Edinburgh|Belfast|Glasgow|Leeds|Birmingham",
    "India": "Bengaluru|Bangalore|Mumbai|Delhi|Gurugram|Gurgaon|Hyderabad|Pune|Chennai|Noida|Kolkata",
    "Canada": "Toronto|Vancouver|Montreal|Montréal|Ottawa|Calgary|Mississauga|Waterloo",
    "Germany": "Berlin|Munich|München|Hamburg|Frankfurt|Cologne|Düsseldorf",
    "France": "Paris|Lyon|Marseille|Toulouse",
    "Netherlands": "Amsterdam|Rotterdam|Utrecht",
    "Ireland": "Dublin|Cork",
    "Spain": "Madrid|Barcelona|Valencia",
    "Portugal": "Lisbon|Porto",
    "Poland": "Warsaw|Krakow|Kraków|Wroclaw|Wrocław|Gdansk",
    "Brazil": "São Paulo|Sao Paulo|Belo Horizonte|Rio de Janeiro|Curitiba|Campinas",
    "Mexico": "Mexico City|Ciudad de Mexico|Guadalajara|Monterrey",
    "Costa Rica": "Heredia",
    "Colombia": "Bogotá|Bogota|Medellín|Medellin",
    "Argentina": "Buenos Aires",
    "Australia": "Sydney|Melbourne|Brisbane|Perth|Adelaide",
    "New Zealand": "Auckland|Wellington",
    "Japan": "Tokyo|Osaka",
    "South Korea": "Seoul",
    "Taiwan": "Taipei|Hsinchu",
    "China": "Shanghai|Beijing|Shenzhen|Hangzhou",
    "Israel": "Tel Aviv|Haifa",
    "Philippines": "Manila|Makati|Cebu|Taguig",
    "Malaysia": "Kuala Lumpur",
    "Thailand": "Bangkok",
    "Vietnam": "Ho Chi Minh City|Hanoi",
    "Indonesia": "Jakarta",
    "United Arab Emirates": "Dubai|Abu Dhabi",
    "Czech Republic": "Prague",
    "Sweden": "Stockholm",
    "Denmark": "Copenhagen",
    "Norway": "Oslo",
    "Finland": "Helsinki",
    "Belgium": "Brussels",
    "Austria": "Vienna",
    "Switzerland": "Zurich|Zürich|Geneva",
    "South Africa": "Cape Town|Johannesburg",
}
#: The United States by name, and where segments end.
UNITED_STATES = r"\b(?:united states(?: of america)?|usa|u\.s\.(?:a\.?)?)(?!\w)|(?-i:\bUS\b)"
SEGMENT_END = r"[;/|]|\s(?:or|and)\s"

#: Without regard to case, for all of Unicode.
ANY = "(?iU)"

_BY_COUNTRY = {**{c.lower(): c for c in COUNTRIES}, **{a.lower(): c for a, c in COUNTRY_ALIASES.items()}}
_BY_CITY = {city.lower(): country for country, cities in CITIES.items() for city in cities.split("|")}


def any_name(names: Iterable[str]) -> str:
    """A pattern of whole names, of which the longest is taken."""
    longest_first = sorted(set(names), key=lambda n: (-len(n), n))
    return rf"(?<!\w)(?:{'|'.join(n.replace('.', '[.]') for n in longest_first)})(?!\w)"


COUNTRY, REGION, CITY = any_name(_BY_COUNTRY), any_name(REGIONS), any_name(_BY_CITY)
STATE, US_CITY = any_name(STATES), any_name(US_CITIES)
STATE_CODE = rf",\s*(?:{STATE_CODES})(?=$|[\s,;/)])"
STATE_AT_END = rf",\s*(?:{'|'.join(STATES)})(?:\s+\d{{5}}(?:-\d{{4}})?)?(?:\s*[-,()]?\s*(?:US|United States|Remote))?\s*$"
ANY_PLACE = any_name([*_BY_COUNTRY, *REGIONS, *_BY_CITY, *STATES, *US_CITIES, "North America", "United States", "USA", "US"])
#: What may stand between a predicate and its place.
LEAD_IN = r"^[ :(\-—–]*(?:(?:only|exclusively|anywhere|the|our|either|remote|multiple locations|locations|offices|in|from|within)\s+)*"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ANY + pattern)


def every(text: Column, pattern: str) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(text, F.lit(f"{ANY}{pattern}"), F.lit(0))


def _looked_up(found: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(found, lambda n: known[F.lower(n)])


def _segment(segment: Column) -> Column:
    def judged(s: Column) -> Column:
        """A country counts unless a state at the end, or the code of one behind it, makes it a place in the States."""
        last_end = F.length(s["rest"]) - F.length(F.regexp_extract(s["rest"], f"(?s){ANY}^.*{COUNTRY}(.*)$", 1))
        before_code = s["coded"] & (last_end <= F.length(F.regexp_extract(segment, f"(?s)^(.*?){STATE_CODE}", 1)))
        american = (s["baja"] == F.lit(False)) & has(segment, STATE_AT_END) | before_code
        countries = F.when(american, F.array().cast("array<string>")).otherwise(_looked_up(s["named"], _BY_COUNTRY))

        def whole(c: Column) -> Column:
            by_name = has(segment, UNITED_STATES)
            local = by_name | (F.size(c) == 0) & ~s["baja"] & (s["coded"] | has(segment, STATE) | has(segment, US_CITY))
            return let(local, lambda us: F.struct(us.alias("us"), c.alias("countries"), regions.alias("regions"), F.when(us, F.array().cast("array<string>")).otherwise(_looked_up(every(segment, CITY), _BY_CITY)).alias("cities")))

        # A region within a country's name is none.
        regions = every(F.regexp_replace(s["rest"], ANY + COUNTRY, ""), REGION)
        return let(countries, whole)

    rest = F.regexp_replace(segment, ANY + r"\bNew Mexico\b", "")
    seen = let(rest, lambda r: F.struct(r.alias("rest"), every(r, COUNTRY).alias("named"), segment.rlike(STATE_CODE).alias("coded"), has(segment, r"\bbaja california\b").alias("baja")))
    return let(seen, judged)


def places(text: Column) -> Column:
    """A struct of us (boolean) and sorted countries, regions (as written) and cities (as their countries). Null text has none."""
    spelt = F.regexp_replace(F.coalesce(text, F.lit("")), ANY + r"\bNewYork\b", "New York")

    def united(parts: Column) -> Column:
        of = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p[name])))).alias(name)
        return F.struct(F.exists(parts, lambda p: p["us"]).alias("us"), of("countries"), of("regions"), of("cities"))

    return let(F.transform(F.split(spelt, ANY + SEGMENT_END), _segment), united)


def starts_with_place(text: Column) -> Column:
    return has(text, LEAD_IN + ANY_PLACE)
