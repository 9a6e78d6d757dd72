"""Varied résumés and profile pages, written by SQL that Spark and DuckDB both run.

The driver's tables hold neither, so each row's text is put together from parts chosen by
its number. What an extractor should find follows from the parts, not from parsing, which is
what the oracles compare with.
"""

from __future__ import annotations

_DEGREE = """case p_partkey % 6 when 0 then 'B.E.COMPUTER SCIENCE' when 1 then 'Bachelor of Science in Physics' when 2 then 'MBA, Finance'
 when 3 then 'M.Tech - Robotics' when 4 then 'BSc in Mathematics' else 'Diploma' end"""
_DATES = "case p_partkey % 4 when 0 then concat(chr(9), '2021 - 2025') when 1 then concat(chr(9), 'Jan 2018 – Present') else '' end"

#: One row a part: the pieces of a résumé.
RESUME_PARTS_SQL = f"""select p_partkey as doc,
 case p_partkey % 4 when 0 then 'Ada Stone' when 1 then 'Bo Rivers' when 2 then 'Cy Marsh' else 'Di Fields' end as name,
 concat('user', p_partkey, ' @example.com | 9', lpad(cast(p_partkey as string), 9, '0')) as contact,
 case p_partkey % 3 when 0 then 'Pune, Maharashtra' when 1 then 'Delhi, New Delhi' else 'Open to travel' end as place,
 case p_partkey % 2 when 0 then 'EDUCATION' else 'Education Details' end as edu_head,
 case p_partkey % 5 when 0 then concat({_DEGREE}, {_DATES}, chr(10), 'Example Technical Campus', chr(9), 'Pune, Maharashtra')
  when 1 then concat({_DEGREE}, {_DATES}, chr(10), 'CGPA: 9.1', chr(10), 'Hill College') when 2 then concat('River Institute', chr(10), {_DEGREE}, {_DATES})
  when 3 then concat({_DEGREE}, {_DATES}) else concat({_DEGREE}, {_DATES}, chr(10), 'Lake School 2015 - 2019') end as edu,
 case p_partkey % 3 when 0 then 'INTERNSHIP EXPERIENCE' when 1 then 'WORK EXPERIENCE' else 'Experience' end as exp_head,
 case p_partkey % 4 when 0 then concat('Web Developer Intern - Acme', p_partkey, chr(10), 'Jan 2024 - Jun 2024') when 1 then concat('Data Analyst, Beta', p_partkey, chr(9), 'Mar 2020 - Present')
  when 2 then concat('Senior Engineer at Gamma', p_partkey, chr(9), '2019 to 2021') else concat('Project Lead', chr(10), '06/2018 - 07/2019') end as jobs,
 case p_partkey % 3 when 0 then 'Python, React, MySQL' when 1 then 'Golang, k8s' else 'Pandas; NumPy' end as skills from part"""
RESUMES_SQL = f"""select doc, concat(name, chr(10), contact, chr(10), place, chr(10), edu_head, chr(10), edu, chr(10), exp_head, chr(10), jobs, chr(10), 'SKILLS', chr(10), skills) as text
 from ({RESUME_PARTS_SQL})"""

_JOB = '<li><h3 class="title">Lead</h3><h4>Acme</h4><span class="date">2019 – 2020</span></li>'
_SCHOOL = '<li><span class="school">Tech</span></li>'
#: One page a customer, with more jobs and schools than are kept for some.
PEOPLE_SQL = f"""select c_custkey as k, concat('https://people.example/', c_custkey) as url, concat(
 case c_custkey % 3 when 0 then concat('<html><head><meta property="og:title" content="', c_name, ' - Engineer at Works | LinkedIn"></head><body>')
  when 1 then concat('<html><body><h1>', c_name, ' | linkedin.com</h1>') else concat('<html><body><div class="x top-card__title">', c_name, '  Junior</div>') end,
 case c_custkey % 4 when 0 then concat('<div><span class="top-card__subline-item">Builder ', c_custkey, '. Of things</span><span class="top-card__subline-item">City</span></div>')
  when 1 then '<h2>Cook · Baker</h2><p class="location">Big  Town</p>' when 2 then '<p class="profile-header__headline">Maker | more</p>' else '' end,
 case when c_custkey % 5 < 3 then concat('<p class="summary">About ', c_custkey, '</p>') else '' end,
 '<span class="skill">Python</span><span class="pill endorsement-item">Go ', c_custkey % 7, '</span><span class="skill">Python</span>',
 '<ul class="experience">', repeat('{_JOB}', cast(c_custkey % 9 as int)), '<li><h3 class="title">Head ', c_custkey, '</h3></li></ul>',
 '<ul class="education-list">', repeat('{_SCHOOL}', cast(c_custkey % 7 as int)), '</ul>',
 case c_custkey % 6 when 0 then '<form id="join-form"></form>' when 1 then 'Join now' else '' end, ' p', c_custkey, '@example.com</body></html>') as html from customer"""

#: Misspelled skills and what they should become: by a weighted ratio of 80 or more, or not at all.
MISSPELLED = {"Pythn": "Python", "Kubernets": "Kubernetes", "TensorFlw": "TensorFlow", "Matplotlb": "Matplotlib", "Elasticserch": "Elasticsearch", "Terrafom": "Terraform", "Confluense": "Confluence", "Zzyzx": None}
