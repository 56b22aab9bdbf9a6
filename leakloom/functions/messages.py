"""Messages of a candidate's status in both languages."""

# Stored status texts must equal those of earlier runs.
MESSAGES = {
    "en": {
        "high_chance": "High chance of leak",
        "medium_chance": "Medium chance of leak",
        "low_chance": "Low chance of leak",
        "no_chance": "No chance of leak",
        "corporate_committer_target": "🎯 CRITICAL: Found committer with TARGET COMPANY email: {name} <{email}> - ALMOST CERTAIN relevance!",
        "corporate_committer_other": "🏢 Corporate email committer: {name} <{email}> (domain: {domain})",
        "repo_credibility_high": "✅ Repository credibility: HIGH ({score:.2f}) - likely real project",
        "repo_credibility_medium": "⚠️ Repository credibility: MEDIUM ({score:.2f})",
        "repo_credibility_low": "❌ Repository credibility: LOW ({score:.2f}) - likely test/example project",
        "repo_is_tiny": "📦 Tiny repository (<10KB) - possible test project",
        "repo_is_personal": "👤 Personal project (single contributor, few commits)",
        "repo_is_popular_oss": "🌟 Popular OSS repository - secrets may be examples",
        "leak_found_in_section": "Leak detected in {obj_type} section for search {dork}",
        "short_description": "Brief description: {description}",
        "no_description": "Brief description: none",
        "topics": "Topics: {topics}",
        "no_topics": "Topics: none",
        "committers_found": "Found the following committers: {committers}. There are {remaining} more committers",
        "committers_all": "Found the following committers: {committers}",
        "first_grepscan_line": "First line found by grepscan: {match}",
        "leaks_found_by_scanner": "Found {count} leaks by {scanner} scanner",
        "total_leaks_found": "Total leaks found: {total_count}",
        "full_report_length": "Full report length: {length}",
        "ai_analysis_company_related": "🤖 AI Analysis: Company-related leak detected (confidence: {confidence:.2f})",
        "ai_analysis_company_unrelated": "🤖 AI Analysis: Not company-related (confidence: {confidence:.2f})",
        "ai_analysis_high_severity": "🤖 AI Analysis: High severity leak detected (score: {score:.2f})",
        "ai_analysis_summary": "🤖 AI Summary: {summary}",
        "profitability_scores": "Leak Profitability Scores: Org Relevance: {org_rel:.2f}, Sensitive Data: {sens_data:.2f}, True Positive: {tp:.2f}, False Positive: {fp:.2f}",
    },
    "ru": {
        "high_chance": "Высокая вероятность утечки",
        "medium_chance": "Средняя вероятность утечки",
        "low_chance": "Низкая вероятность утечки",
        "no_chance": "Нет вероятности утечки",
        "corporate_committer_target": "🎯 ВАЖНО: Найден коммитер с email ЦЕЛЕВОЙ КОМПАНИИ: {name} <{email}> - ПОЧТИ 100% релевантность!",
        "corporate_committer_other": "🏢 Коммитер с корпоративным email: {name} <{email}> (домен: {domain})",
        "repo_credibility_high": "✅ Достоверность репозитория: ВЫСОКАЯ ({score:.2f}) - вероятно реальный проект",
        "repo_credibility_medium": "⚠️ Достоверность репозитория: СРЕДНЯЯ ({score:.2f})",
        "repo_credibility_low": "❌ Достоверность репозитория: НИЗКАЯ ({score:.2f}) - вероятно тестовый/пример",
        "repo_is_tiny": "📦 Микро-репозиторий (<10KB) - возможно тестовый проект",
        "repo_is_personal": "👤 Персональный проект (один контрибутор, мало коммитов)",
        "repo_is_popular_oss": "🌟 Популярный OSS репозиторий - секреты могут быть примерами",
        "leak_found_in_section": "Обнаружена утечка в разделе {obj_type} по поиску {dork}",
        "short_description": "Краткое описание: {description}",
        "no_description": "Краткое описание: отсутствует",
        "topics": "Топики: {topics}",
        "no_topics": "Топики: отсутствуют",
        "committers_found": "Обнаружены следующие коммитеры: {committers}. Еще есть {remaining} коммитеров",
        "committers_all": "Обнаружены следующие коммитеры: {committers}",
        "first_grepscan_line": "Первая строка, найденная grepscan: {match}",
        "leaks_found_by_scanner": "Найдено {count} утечек {scanner} сканером",
        "total_leaks_found": "Всего обнаружено утечек: {total_count}",
        "full_report_length": "Длина полного отчета: {length}",
        "ai_analysis_company_related": "🤖 ИИ Анализ: Обнаружена утечка, связанная с компанией (уверенность: {confidence:.2f})",
        "ai_analysis_company_unrelated": "🤖 ИИ Анализ: Не связано с компанией (уверенность: {confidence:.2f})",
        "ai_analysis_high_severity": "🤖 ИИ Анализ: Обнаружена утечка высокой степени серьезности (оценка: {score:.2f})",
        "ai_analysis_summary": "🤖 ИИ Резюме: {summary}",
        "profitability_scores": "Оценка рентабельности утечки: Релевантность организации: {org_rel:.2f}, Чувствительные данные: {sens_data:.2f}, Истинно-положительный: {tp:.2f}, Ложно-положительный: {fp:.2f}",
    },
}
