"""Schemas of the relations, as Spark DDL."""

FETCHES = "url string, status_code int, headers map<string,string>, html_content string, engine_used string, is_blocked boolean, error_message string, extra_meta map<string,string>"
COMPANIES = "id string, domain string not null, name string, industry string, company_size string, website_url string, hq_phone string, linkedin_url string, twitter_url string, extra_metadata map<string,string>, created_at timestamp, updated_at timestamp"
LEADS = "id string, company_id string, first_name string, last_name string, title string, seniority string, department string, work_email string not null, email_status string, email_verified_at timestamp, source_platform string, phones array<struct<number:string,type:string>>, linkedin_url string, email_verified boolean, mx_valid boolean, disposable_flag boolean, created_at timestamp, updated_at timestamp"
TECHNOLOGIES = "id string, company_id string not null, tech_name string not null, category string, detected_at timestamp"
LOGS = "id string, url string not null, domain string not null, status_code int, engine_used string, error_message string, scraped_at timestamp"
MX_LOOKUP = "domain string, mx_records array<string>, lookup_error string"
SMTP_PROBE = "email string, mx_rank int, rcpt_code int, catch_all_probe_code int, error string"
CATCH_ALL = "domain string, is_catch_all boolean"
