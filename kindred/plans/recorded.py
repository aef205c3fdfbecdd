"""Recorded rows that the queries on Double Metaphone and the default scorer are held against."""

# Word, primary and secondary key.
METAPHONE = (
    ('', '', ''),
    ('Alexander', 'ALKS', 'ALKS'),
    ('Athens', 'A0NS', 'ATNS'),
    ('Bologna', 'PLN', 'PLKN'),
    ('Cabrillo', 'KPRL', 'KPRL'),
    ('Caesar', 'SSR', 'SSR'),
    ('Catania', 'KTN', 'KTN'),
    ('Catherine', 'K0RN', 'KTRN'),
    ('Chang', 'KNK', 'KNK'),
    ('Chen', 'XN', 'KN'),
    ('Cheung', 'XNK', 'KNK'),
    ('Christopher', 'XRST', 'XRST'),
    ('Czapski', 'SPSK', 'XPSK'),
    ('Dvorak', 'TFRK', 'TFRK'),
    ('Fischer', 'FXR', 'FSKR'),
    ('Garcia', 'KRS', 'KRX'),
    ('Goebel', 'KPL', 'KPL'),
    ('Hong', 'HNK', 'HNK'),
    ('Jaramillo', 'JRML', 'ARML'),
    ('Katherine', 'K0RN', 'KTRN'),
    ('Knauer', 'NR', 'NR'),
    ('Knock', 'NK', 'NK'),
    ('Kowalski', 'KLSK', 'KLSK'),
    ('Moreno', 'MRN', 'MRN'),
    ('Mueller', 'MLR', 'MLR'),
    ('Neumann', 'NMN', 'NMN'),
    ('Nicholas', 'NXLS', 'NXLS'),
    ('Nowak', 'NK', 'NK'),
    ('Pacheco', 'PXK', 'PXK'),
    ('Schmidt', 'XMT', 'SMT'),
    ('Schwartz', 'XRTS', 'XRTS'),
    ('Sczepanski', 'SKPN', 'SKPN'),
    ('Smith', 'SM0', 'XMT'),
    ('Theodore', '0TR', 'TTR'),
    ('Thompson', 'TMPS', 'TMPS'),
    ('Vogel', 'FJL', 'FKL'),
    ('Wagner', 'AKNR', 'FKNR'),
    ('Wisnewski', 'ASNS', 'FSNS'),
    ('Wojcik', 'AJSK', 'FHSK'),
    ('Wong', 'ANK', 'FNK'),
    ('Xavier', 'KSF', 'KSFR'),
)

# Pairs, the default scorer's score, and whether it counts as a match.
DEFAULT = (
    ('user_id', 'userId', 0.9999999999999999, True),
    ('created_at', 'creationTimestamp', 0.26955026455026454, False),
    ('status', 'state', 0.4219047619047619, False),
    ('email', 'e_mail', 0.6257936507936508, False),
    ('org_id', 'organisation_id', 0.29106753812636166, False),
    ('latitude', 'longitude', 0.3672008547008547, False),
    ('is_deleted', 'is_active', 0.25943562610229276, False),
    ('hello', 'hello', 0.9999999999999999, True),
    ('', '', 0.9999999999999999, True),
    ('', 'hello', 0.0, False),
    ('café', 'cafe', 0.5163888888888889, False),
    ('Smith', 'Schmidt', 0.36083333333333334, False),
    ('config', 'configs', 0.7529100529100529, False),
    ('abc', 'xyz', 0.0, False),
    ('abbreviation', 'abreviation', 0.7439704058125111, False),
)

# Items (name, group) of the scans, in their places.
ITEMS = (
    ('user_id', 'login'),
    ('userId', 'login'),
    ('user_name', 'login'),
    ('user_id', 'profile'),
    ('userId', 'profile'),
)

# Scan, kind, names, groups and score of its warnings.
WARNINGS = (
    ('DefaultConfig', 'WithinGroup', 'userId', 'user_id', 'login', 'login', 0.9999999999999999),
    ('DefaultConfig', 'WithinGroup', 'userId', 'user_id', 'profile', 'profile', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled', 'WithinGroup', 'userId', 'user_id', 'login', 'login', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled', 'WithinGroup', 'userId', 'user_id', 'profile', 'profile', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'WithinGroup', 'userId', 'user_id', 'login', 'login', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'WithinGroup', 'userId', 'user_id', 'profile', 'profile', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'AcrossGroups', 'userId', 'userId', 'login', 'profile', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'AcrossGroups', 'userId', 'user_id', 'login', 'profile', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'AcrossGroups', 'userId', 'user_id', 'profile', 'login', 0.9999999999999999),
    ('DefaultConfig_CrossEnabled_AllowIdentical', 'AcrossGroups', 'user_id', 'user_id', 'login', 'profile', 0.9999999999999999),
)
