"""What is settled before a job runs: parsed queries, guards, routes, tuned settings."""
