"""What the sample pages yield: recorded from a run of the parser, each row then checked against the rules of extraction by reading."""

from __future__ import annotations

#: url, page_type, soft_404, target_website, domain, name, website_url, industry, company_size, hq_phone, linkedin_url, twitter_url
COMPANIES = [
    ("https://goodfirms.co/directory/harbour-logistics?page=3", "directory_listing", False, None, None, None, None, None, None, None, None, None),
    ("https://clutch.co/profile/kestrel-freight", "directory_profile", False, "https://www.kestrel-freight.example.com/", "kestrel-freight.example.com", "Kestrel Freight", "https://www.kestrel-freight.example.com/", "Road & Rail Warehousing Hubs", "50-249", None, "https://www.linkedin.com/company/kestrel-freight", "https://x.com/kestrelfreight"),
    ("https://www.designrush.com/agency/morrow-lines", "directory_profile", False, "https://morrow-lines.example.net/", "morrow-lines.example.net", "Morrow Lines Ltd", "https://morrow-lines.example.net/", "Ferries; Port services", "11-50", None, None, "https://twitter.com/morrowlines"),
    ("https://www.designrush.com/agency/nobody", "directory_profile", False, None, None, None, None, None, None, None, None, None),
    ("https://www.larkspur.example.com/contact", "company_site", False, None, "larkspur.example.com", "Larkspur Instruments", "https://larkspur.example.com/", "Optics; Sensors", "120", "+49 30 901820", "https://www.linkedin.com/company/larkspur-instruments", None),
    ("https://terntide.example.com/team", "company_site", False, None, "terntide.example.com", "Team", "https://terntide.example.com/", None, None, None, None, None),
    ("https://terntide.example.com/gone", "company_site", True, None, "terntide.example.com", "Harbour firms", "https://terntide.example.com/", None, None, None, None, None),
    ("https://terntide.example.com/missing", "company_site", True, None, "terntide.example.com", "Error 404", "https://terntide.example.com/", None, None, None, None, None),
    ("https://terntide.example.com/stories", "company_site", False, None, "terntide.example.com", "Stories", "https://terntide.example.com/", None, None, None, None, None),
    ("https://terntide.example.com/empty", "company_site", False, None, "terntide.example.com", "terntide", "https://terntide.example.com/", None, None, None, None, None),
]

#: url, work_email, first_name, last_name, title, seniority, department, phones, linkedin_url
LEADS = [
    ("https://clutch.co/profile/kestrel-freight", "quotes@kestrel-freight.example.com", None, None, None, None, None, "+44 20 7946 0018 mobile", None),
    ("https://clutch.co/profile/kestrel-freight", "olga_brandt@depot.example.com", "Olga", "Brandt", "Director", "director", None, "(212) 555-0142 office", "https://uk.linkedin.com/in/olga-brandt"),
    ("https://www.larkspur.example.com/contact", "ivo.marek@larkspur.example.com", "Ivo", "Marek", "Head Of Research", "director", None, "+420 601 123 456 mobile", None),
    ("https://www.larkspur.example.com/contact", "press@larkspur.example.com", None, None, None, None, None, "", None),
    ("https://www.larkspur.example.com/contact", "annalee2@mail.larkspur.example.com", None, None, None, None, None, "", None),
    ("https://www.larkspur.example.com/contact", "noname77@larkspur.example.com", None, None, None, None, None, "", None),
    ("https://www.larkspur.example.com/contact", "sales@larkspur.example.com", None, None, None, None, None, "", None),
]

#: url, n, first_name, last_name, title, seniority, department, linkedin_url, candidates
PERSONS = [
    ("https://terntide.example.com/team", 0, "Ruth", "McAllister", "Chief Financial Officer", "c_level", None, "https://linkedin.com/in/ruth-mcallister", "ruth.mcallister@terntide.example.com, ruthmcallister@terntide.example.com, rmcallister@terntide.example.com, ruth@terntide.example.com"),
    ("https://terntide.example.com/team", 1, "Ben", "Okafor", "Lead of nothing in particular, but Marketing Manager by day", "manager", "Marketing", None, "ben.okafor@terntide.example.com, benokafor@terntide.example.com, bokafor@terntide.example.com, ben@terntide.example.com"),
    ("https://terntide.example.com/team", 2, "Jo", "Lind", "Partner, Hamburg office", "c_level", None, None, "jo.lind@terntide.example.com, jolind@terntide.example.com, jlind@terntide.example.com, jo@terntide.example.com"),
]

#: url, kind, n, link
LINKS = [
    ("https://goodfirms.co/directory/harbour-logistics?page=3", "profile", 0, "https://goodfirms.co/company/kestrel-freight"),
    ("https://goodfirms.co/directory/harbour-logistics?page=3", "profile", 1, "https://goodfirms.co/company/morrow-lines"),
    ("https://goodfirms.co/directory/harbour-logistics?page=3", "pagination", 0, "https://goodfirms.co/directory/harbour-logistics?page=4"),
    ("https://goodfirms.co/directory/harbour-logistics?page=3", "pagination", 1, "https://goodfirms.co/directory/harbour-logistics?page=9"),
    ("https://www.larkspur.example.com/contact", "internal", 0, "https://larkspur.example.com/about"),
    ("https://www.larkspur.example.com/contact", "internal", 1, "https://larkspur.example.com/team/people?ref=nav"),
    ("https://www.larkspur.example.com/contact", "internal", 2, "https://larkspur.example.com/products/lens"),
]

#: url, kind, name, value
FACTS = [
    ("https://www.designrush.com/agency/morrow-lines", "metadata", "description", "Ferries since 1971"),
    ("https://www.designrush.com/agency/morrow-lines", "metadata", "founded_year", "1971"),
    ("https://www.designrush.com/agency/morrow-lines", "metadata", "headquarters", "Bergen, NO"),
    ("https://www.larkspur.example.com/contact", "technology", "WordPress", "CMS"),
    ("https://www.larkspur.example.com/contact", "technology", "HubSpot", "Marketing"),
    ("https://terntide.example.com/team", "technology", "Gatsby", "Framework"),
]

#: seq, outcome, reason, next_attempt_at
OUTCOMES = [
    (0, "success", "listing", None),
    (1, "success", None, None),
    (2, "success", None, None),
    (3, "incomplete", "no_company", None),
    (4, "success", None, None),
    (5, "success", None, None),
    (6, "failed", "soft_404", None),
    (7, "failed", "not_found", None),
    (8, "retry", "blocked", "2024-03-01 00:04:00"),
    (9, "skipped", "cooldown", None),
]

#: work_email, company_domain, first_name, last_name, title, email_status, email_verified, mx_valid, verified_at, source_platform
TASK_LEADS = [
    ("annalee2@mail.larkspur.example.com", "larkspur.example.com", None, None, None, "invalid", False, False, None, "direct"),
    ("ivo.marek@larkspur.example.com", "larkspur.example.com", "Ivo", "Marek", "Head Of Research", "verified", True, True, "2024-03-01", "direct"),
    ("noname77@larkspur.example.com", "larkspur.example.com", None, None, None, "unverified", False, True, None, "direct"),
    ("olga_brandt@depot.example.com", "kestrel-freight.example.com", "Olga", "Brandt", "Director", "invalid", False, False, None, "clutch.co"),
    ("press@larkspur.example.com", "larkspur.example.com", None, None, None, "invalid", False, True, "2024-03-01", "direct"),
    ("quotes@kestrel-freight.example.com", "kestrel-freight.example.com", None, None, None, "unverified", False, True, None, "clutch.co"),
    ("ruthmcallister@terntide.example.com", "terntide.example.com", "Ruth", "McAllister", "Chief Financial Officer", "verified", True, True, "2024-03-01", "direct"),
    ("sales@larkspur.example.com", "larkspur.example.com", None, None, None, "catch_all", False, True, "2024-03-01", "direct"),
]

#: url, depth
FRONTIER = [
    ("https://goodfirms.co/company/kestrel-freight", 0),
    ("https://goodfirms.co/company/morrow-lines", 0),
    ("https://goodfirms.co/directory/harbour-logistics?page=4", 0),
    ("https://goodfirms.co/directory/harbour-logistics?page=9", 0),
    ("https://larkspur.example.com/about", 0),
    ("https://larkspur.example.com/products/lens", 0),
    ("https://larkspur.example.com/team/people?ref=nav", 0),
    ("https://morrow-lines.example.net/", 1),
    ("https://www.kestrel-freight.example.com/", 1),
]
