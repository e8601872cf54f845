"""SQL for the queries that SQL can express on whole tables; the others have tests against brute force."""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT row_id FROM chunks WHERE length(content) > 800",
    }
