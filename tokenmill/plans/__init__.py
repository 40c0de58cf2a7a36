"""Query shapes shared by the jobs: ordered scans, joins, adapters and mixtures."""
